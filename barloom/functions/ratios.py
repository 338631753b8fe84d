"""Ratios and statistics that give NULL, not an error, where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vwap(price: Column, volume: Column) -> Column:
    return F.try_divide(F.sum(price * volume), F.sum(volume).cast("double"))


def change_percent(now: Column, before: Column) -> Column:
    return F.try_divide((now - before) * 100, before)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are set; NULL on zero variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def midpoint(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2
