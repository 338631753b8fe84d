"""Ticks to bars and bars to coarser bars."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import DataValidationError
from barloom.functions import clock
from barloom.functions.ratios import vwap

_SECONDS = {"second": 1, "minute": 60, "hour": 3600}
_FIXED = tuple(_SECONDS)
_CALENDAR = ("day", "week", "month", "quarter", "year")
TIMESPANS = _FIXED + _CALENDAR


def bar_start(ts: Column, multiplier: int, timespan: str) -> Column:
    """Start of the bar that holds market time ``ts``.

    Seconds to hours count from midnight of 1970-01-01, weeks from Monday
    1970-01-05, months and longer from January of year 0.
    """
    if timespan not in TIMESPANS or multiplier < 1:
        raise DataValidationError(f"no bars of {multiplier} {timespan}")
    if timespan in _FIXED:
        return F.window(ts, f"{multiplier} {timespan}").getField("start")
    if timespan == "day":
        days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
        start = F.date_add(F.lit("1970-01-01").cast("date"), _whole(days, multiplier))
    elif timespan == "week":
        days = F.datediff(F.to_date(ts), F.lit("1970-01-05").cast("date"))
        start = F.date_add(F.lit("1970-01-05").cast("date"), _whole(days, 7 * multiplier))
    else:
        months = F.year(ts) * 12 + F.month(ts) - 1
        length = {"month": 1, "quarter": 3, "year": 12}[timespan] * multiplier
        first = _whole(months, length)
        start = F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1))
    return start.cast("timestamp_ntz")


def _whole(value: Column, length: int) -> Column:
    return (F.floor(value / length) * length).cast("int")


def in_sequence(time_number: Column, sequence: Column) -> Column:
    """One number that orders by time, then sequence; NULL comes first in either.

    A fixed-width value keeps the aggregation a hash aggregation; a struct would
    sort every row by key before the first combine.
    """
    least = F.lit(-(1 << 63)).cast("bigint")
    step = F.lit(Decimal(10) ** 19).cast("decimal(20,0)")
    return F.coalesce(time_number, least).cast("decimal(19,0)") * step + F.coalesce(sequence.cast("bigint"), least).cast("decimal(20,0)")


def bars_from_trades(trades: DataFrame, multiplier: int = 1, timespan: str = "minute", time: str = "ts",
                     sequence: str = "sequence", key: str = "ticker") -> DataFrame:
    """Trades with UTC times to market-time bars with VWAP and average size.

    Open and close follow ``(time, sequence)``, so equal times stay deterministic.
    """
    first = in_sequence(clock.epoch_ns(F.col(time)), F.col(sequence))
    # Zone offsets are whole quarters of an hour: bars that fit into one are cut in
    # UTC, and only their starts are converted, not every trade.
    fits = timespan in _SECONDS and 900 % (multiplier * _SECONDS[timespan]) == 0
    start = bar_start(F.col(time) if fits else clock.to_market(F.col(time)), multiplier, timespan)
    made = trades.groupBy(key, start.alias("window_start_et")).agg(
        F.min_by("price", first).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("transactions"),
        vwap(F.col("price"), F.col("size")).alias("vwap"),
        F.avg("size").alias("average_size"),
    )
    return made.withColumn("window_start_et", clock.to_market(F.col("window_start_et"))) if fits else made


def resample(bars: DataFrame, multiplier: int = 5, timespan: str = "minute", fill_gaps: bool = False,
             session_only: bool = False, time: str = "window_start_et", key: str = "ticker") -> DataFrame:
    """Bars to coarser bars per ticker: first, max, min, last, and summed amounts.

    ``fill_gaps`` adds the empty bars between a ticker's first and last bar, with
    NULL prices and zero amounts; ``session_only`` keeps only those that start in
    trading hours on a weekday.
    """
    coarse = bars.groupBy(key, bar_start(F.col(time), multiplier, timespan).alias("bar_start")).agg(
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("transactions").alias("transactions"),
    )
    if not fill_gaps:
        return coarse
    if timespan not in _FIXED:
        raise DataValidationError("gaps are filled for bars of seconds, minutes or hours")
    # A ticker has one coarse bar per slot, so the calendar bounds this window.
    after = F.lead("bar_start").over(W.partitionBy(key).orderBy("bar_start"))
    step = multiplier * _SECONDS[timespan]
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")

    def seconds(column: str) -> Column:
        return F.timestamp_diff("SECOND", epoch, F.col(column))

    # Slots are made day by day, and for the session only its own, so no row holds more than a day of them.
    opens, closes = (clock.OPEN_MINUTE * 60, clock.CLOSE_MINUTE * 60 - 1) if session_only else (0, 86_399)
    gaps = coarse.withColumn("_next", after).withColumn("_a", seconds("bar_start")).withColumn(
        "_b", F.coalesce(seconds("_next") - step, F.col("_a")))
    days = gaps.select("*", F.explode(F.sequence(F.expr("_a div 86400"), F.expr("_b div 86400"))).alias("_day"))
    if session_only:
        days = days.filter(F.weekday(F.date_add(F.lit("1970-01-01").cast("date"), F.col("_day").cast("int"))) < 5)
    low = F.greatest(F.col("_a"), F.col("_day") * 86_400 + opens)
    spread = days.withColumn("_low", F.col("_a") + F.ceil((low - F.col("_a")) / step) * step).withColumn(
        "_high", F.least(F.col("_b"), F.col("_day") * 86_400 + closes)).filter("_low <= _high")
    slots = spread.select("*", F.explode(F.sequence("_low", "_high", F.lit(step).cast("bigint"))).alias("_slot"))
    traded = F.col("_slot") == F.col("_a")
    return slots.select(
        key, F.timestamp_add("SECOND", F.col("_slot"), epoch).alias("bar_start"),
        *[F.when(traded, F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        *[F.when(traded, F.col(c)).otherwise(0).alias(c) for c in ("volume", "transactions")])


def aggregate_bars(bars: DataFrame, multiplier: int, timespan: str, start=None, end=None,
                   sort: str = "asc", limit: int | None = None, include_otc: bool = True,
                   time: str = "window_start_et", key: str = "ticker") -> DataFrame:
    """Bars of any size with VWAP, optionally for a date range, sorted and limited."""
    rows = bars
    if start is not None:
        rows = rows.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col(time) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if not include_otc and "otc" in rows.columns:
        rows = rows.filter(~F.coalesce(F.col("otc"), F.lit(False)))
    weight = F.col("vwap") if "vwap" in bars.columns else F.col("close")
    out = rows.groupBy(key, bar_start(F.col(time), multiplier, timespan).alias("bar_start")).agg(
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
        vwap(weight, F.col("volume")).alias("vwap"),
        F.sum("transactions").alias("transactions"),
    )
    if limit is None:
        return out
    by = F.col("bar_start").desc() if sort == "desc" else F.col("bar_start").asc()
    return out.orderBy(by, key).limit(limit)


def grouped_daily(bars: DataFrame, day, include_otc: bool = False) -> DataFrame:
    """The daily bar of every ticker on one market day."""
    return aggregate_bars(bars, 1, "day", start=day, end=day, include_otc=include_otc)


def daily_sessions(bars: DataFrame, time: str = "window_start_et", key: str = "ticker") -> DataFrame:
    """Regular-session bar per ticker and day, with pre-market and after-hours prices.

    ``pre_market`` is the first price before 09:30, ``early_close`` the last one;
    ``after_hours`` is the last price from 16:00 on. Days without a regular trade
    have NULL open, high, low and close and zero volume.
    """
    session = clock.session_of(F.col(time))

    def at(name: str) -> Column:
        return F.when(session == name, F.col(time))

    def regular(column: str) -> Column:
        return F.when(session == "regular", F.col(column))

    return bars.groupBy(key, F.to_date(time).alias("trade_date")).agg(
        F.min_by("open", at("regular")).alias("open"),
        F.max(regular("high")).alias("high"),
        F.min(regular("low")).alias("low"),
        F.max_by("close", at("regular")).alias("close"),
        F.coalesce(F.sum(regular("volume")), F.lit(0)).alias("volume"),
        F.min_by("open", at("pre")).alias("pre_market"),
        F.max_by("close", at("pre")).alias("early_close"),
        F.max_by("close", at("post")).alias("after_hours"),
    )
