"""Time expressions. None of them depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
OPEN_MINUTE = 9 * 60 + 30
CLOSE_MINUTE = 16 * 60

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_MICROS_PER = {"s": 1_000_000, "ms": 1_000, "us": 1}


def utc_from_epoch(value: Column, unit: str = "ns") -> Column:
    """UTC wall clock (``TIMESTAMP_NTZ``) of an epoch number in s, ms, us or ns."""
    if unit == "ns":
        micros = F.call_function("div", value.cast("bigint"), F.lit(1000).cast("bigint"))
    else:
        micros = value.cast("bigint") * F.lit(_MICROS_PER[unit])
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def epoch_ns(utc: Column) -> Column:
    """Epoch nanoseconds of a UTC wall clock."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), utc) * F.lit(1000)


def epoch_us(utc: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), utc)


def epoch_ms(utc: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.expr(_EPOCH), utc)


def to_market(utc: Column, zone: str = MARKET_ZONE) -> Column:
    """Market wall clock of a UTC wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def to_utc(market: Column, zone: str = MARKET_ZONE) -> Column:
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), market)


def market_from_epoch(value: Column, unit: str = "ns", zone: str = MARKET_ZONE) -> Column:
    return to_market(utc_from_epoch(value, unit), zone)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_trading_hours(ts: Column) -> Column:
    """09:30 up to, not including, 16:00 market time."""
    return minute_of_day(ts).between(OPEN_MINUTE, CLOSE_MINUTE - 1)


def is_weekday(ts: Column) -> Column:
    return F.dayofweek(ts).between(2, 6)


def session_of(ts: Column) -> Column:
    """``pre`` before 09:30, ``regular``, ``post`` from 16:00."""
    minute = minute_of_day(ts)
    return (
        F.when(minute < OPEN_MINUTE, "pre").when(minute < CLOSE_MINUTE, "regular").otherwise("post")
    )

