"""Whole-row set operations: stacking, differences, duplicates, latest rows, ordering."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.errors import DataValidationError
from barloom.functions import clock


def stack(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; columns a frame lacks become NULL."""
    if not frames:
        raise DataValidationError("nothing to stack")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_keys(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``incoming`` that are not stored."""
    return incoming.select(*keys).subtract(stored.select(*keys))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row duplicates removed; copies collapse before the shuffle."""
    return df.dropDuplicates()


def distinct_keys(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    return latest_row(df, keys, order)


# Types of fixed width; an aggregate over them alone is a hash aggregate, with nothing sorted.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_FIXED = (*_WHOLE, *_TIMES, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def _rank(df: DataFrame, order: list[str]) -> Column | None:
    """One number of fixed width that sorts as ``order`` does, NULL first; None where the types allow none."""
    kinds = [df.schema[c].dataType for c in order]
    if not isinstance(kinds[0], (*_WHOLE, *_TIMES)) or len(order) > 2 or not all(isinstance(k, _WHOLE) for k in kinds[1:]):
        return None
    first, kind = F.col(order[0]), kinds[0]
    if isinstance(kind, T.DateType):
        first = F.unix_date(first)
    elif isinstance(kind, T.TimestampType):
        first = F.unix_micros(first)
    elif isinstance(kind, T.TimestampNTZType):
        first = clock.epoch_us(first)
    if len(order) == 1:
        return F.coalesce(first.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 64))))
    if isinstance(kind, T.LongType):
        # Times the second column's range this would not fit.
        return None
    # Times stay below 2^58 microseconds, so this has at most 38 digits.
    wide = F.coalesce(first.cast("decimal(18,0)"), F.lit(Decimal(-(1 << 59)))) * F.lit(Decimal(1 << 64)).cast("decimal(20,0)")
    return (wide + F.coalesce(F.col(order[1]).cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))).cast("decimal(38,0)")


def latest_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``.

    Rows of plain numbers and times ordered by a time and a number are hash
    aggregated: one number carries the order, and every column follows it. Other
    rows are aggregated as a whole, which sorts within each task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = _rank(df, order) if all(isinstance(df.schema[c].dataType, _FIXED) for c in rest) else None
    if rank is None:
        picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return picked.select(*keys, "_row.*")
    return df.withColumn("_rank", rank).groupBy(*keys).agg(*[F.max_by(c, "_rank").alias(c) for c in rest])


def reconcile(wanted: DataFrame, active: DataFrame) -> DataFrame:
    """Rows to add and to remove so that ``active`` becomes ``wanted``."""
    return wanted.subtract(active).withColumn("action", F.lit("add")).unionByName(
        active.subtract(wanted).withColumn("action", F.lit("remove")))


def sorted_limit(df: DataFrame, sort: str, order: str = "asc", limit: int | None = None,
                 tie: list[str] | None = None) -> DataFrame:
    """Rows ordered by ``sort`` then ``tie``, at most ``limit`` of them."""
    by = F.col(sort).desc_nulls_last() if order == "desc" else F.col(sort).asc_nulls_last()
    out = df.orderBy(by, *(tie or []))
    return out if limit is None else out.limit(limit)


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
