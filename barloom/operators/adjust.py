"""Split adjustment, ticker renames and the trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import clock

_FIRST_DAY = "1000-01-01"
_LAST_DAY = "9999-12-31"


def split_factors(splits: DataFrame, key: str = "ticker") -> DataFrame:
    """Per ticker, adjoining date ranges ``[valid_from, valid_to)`` and their price factor.

    The factor is the product of ``split_from / split_to`` over all splits
    executed after the range; splits of one day are multiplied together.
    """
    per_day = splits.groupBy(key, "execution_date").agg(
        F.product(F.col("split_from") / F.col("split_to")).alias("_ratio"))
    later = W.partitionBy(key).orderBy(F.col("execution_date").desc())
    running = later.rowsBetween(W.unboundedPreceding, W.currentRow)
    # Row of a split covers the days before it, back to the split before.
    return per_day.select(
        key,
        F.coalesce(F.lead("execution_date").over(later), F.lit(_FIRST_DAY).cast("date")).alias("valid_from"),
        F.col("execution_date").alias("valid_to"),
        F.product("_ratio").over(running).alias("factor"),
    )


def split_adjusted(bars: DataFrame, splits: DataFrame, time: str = "window_start_et",
                   key: str = "ticker") -> DataFrame:
    """Bars before a split scaled to today's share; a bar on the execution date is not scaled."""
    day = F.to_date(bars[time])
    ranges = split_factors(splits, key).withColumnRenamed(key, "_key")
    joined = bars.join(
        ranges, (bars[key] == ranges["_key"]) & (day >= ranges["valid_from"]) & (day < ranges["valid_to"]),
        "left")
    factor = F.coalesce("factor", F.lit(1.0))
    prices = [c for c in ("open", "high", "low", "close", "vwap") if c in bars.columns]
    scaled = joined.withColumns({c: F.col(c) * factor for c in prices})
    scaled = scaled.withColumn("volume", F.col("volume") / factor)
    return scaled.select(*bars.columns, factor.alias("split_factor"))


def rename_ranges(renames: DataFrame) -> DataFrame:
    """Per instrument, the symbol valid in ``[valid_from, valid_to)`` and the current symbol.

    ``renames`` holds ``instrument, date, ticker``: from ``date`` on the
    instrument trades as ``ticker``.
    """
    w = W.partitionBy("instrument").orderBy("date")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return renames.select(
        "instrument", F.col("ticker").alias("old_ticker"), F.col("date").alias("valid_from"),
        F.coalesce(F.lead("date").over(w), F.lit(_LAST_DAY).cast("date")).alias("valid_to"),
        F.last("ticker").over(whole).alias("current_ticker"),
    )


def current_symbols(bars: DataFrame, renames: DataFrame, time: str = "window_start_et",
                    key: str = "ticker") -> DataFrame:
    """Add ``current_ticker``: the symbol under which the bar's instrument trades now."""
    day = F.to_date(bars[time])
    ranges = rename_ranges(renames)
    joined = bars.join(
        ranges,
        (bars[key] == ranges["old_ticker"]) & (day >= ranges["valid_from"]) & (day < ranges["valid_to"]),
        "left")
    return joined.select(*bars.columns, F.coalesce("current_ticker", bars[key]).alias("current_ticker"))


def on_trading_calendar(bars: DataFrame, holidays: DataFrame, exchange: str,
                        time: str = "window_start_et") -> DataFrame:
    """Bars without closed days, and without the part after an early close.

    ``holidays`` holds ``exchange, date, status`` (``closed`` or ``early-close``)
    and ``close``, the market time ``HH:MM`` of an early close. One exchange has
    at most one row per day, which bounds the broadcast.
    """
    days = holidays.filter(F.col("exchange") == exchange).groupBy(F.col("date").alias("_date")).agg(
        F.max(F.col("status") == "closed").alias("_closed"),
        F.min(F.when(F.col("status") == "early-close", F.col("close"))).alias("_close"))
    joined = bars.join(F.broadcast(days), F.to_date(bars[time]) == F.col("_date"), "left")
    close_minute = F.split_part("_close", F.lit(":"), F.lit(1)).cast("int") * 60 \
        + F.split_part("_close", F.lit(":"), F.lit(2)).cast("int")
    open_day = ~F.coalesce("_closed", F.lit(False))
    in_time = F.col("_close").isNull() | (clock.minute_of_day(F.col(time)) < close_minute)
    return joined.filter(open_day & in_time).select(*bars.columns)
