"""Statistics per ticker, daily VWAP and correlation with a base ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.ratios import correlation, vwap
from barloom.session import steering

QUARTILES = {"q1_price": 0.25, "median_price": 0.5, "q3_price": 0.75}
# Value ranges per doubling: a range spans about 0.14 percent of its value, however small or large that is.
RANGES_PER_DOUBLING = 512
# Above the smallest exponent of a double, so that the ranges of positive values are positive.
_SMALLEST = 1100


def exact_quantiles(df: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key, exact, without one buffer per key.

    Rows are first counted per value range, which combines before the shuffle to
    a few thousand counts per key. They tell which few ranges hold the wanted
    ranks; only the distinct values of those ranges are shuffled and ordered.
    Missing values and NaN are left out.
    """
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).select(
        key, number.alias("_v"), _value_range(number).alias("_cell"))
    cells = rows.groupBy(key, "_cell").agg(F.count("*").alias("_rows"))
    upto = W.partitionBy(key).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    cells = cells.withColumns({
        "_end": F.sum("_rows").over(upto), "_total": F.sum("_rows").over(W.partitionBy(key))})
    # Zero-based ranks on both sides of every percentile position.
    ranks = [_rank(p, floor) for p in probs.values() for floor in (True, False)]
    start = F.col("_end") - F.col("_rows")
    holds = None
    for rank in ranks:
        one = (rank >= start) & (rank < F.col("_end"))
        holds = one if holds is None else holds | one
    wanted = cells.filter(holds).select(key, "_cell", "_total", start.alias("_before"))
    steer = steering(wanted.withColumnsRenamed({key: "_key", "_cell": "_range"}), "ranges")
    met = rows.join(steer, rows[key].eqNullSafe(steer["_key"]) & (rows["_cell"] == steer["_range"]))
    counts = met.groupBy(key, "_cell", "_total", "_before", "_v").agg(
        F.count("*").alias("_n"))
    inside = W.partitionBy(key, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).withColumn(
        "_from", F.col("_upto") - F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_upto")), F.col("_v")))

    parts, outs = [], []
    for name, p in probs.items():
        parts += [at(_rank(p, True)).alias(f"_{name}_lo"), at(_rank(p, False)).alias(f"_{name}_hi")]
        share = (F.col("_total") - 1) * F.lit(p)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((low + (high - low) * (share - F.floor(share))).alias(name))
    return placed.groupBy(key, "_total").agg(*parts).select(key, *outs)


def _value_range(number: Column) -> Column:
    """A whole number that never falls when the value rises."""
    size = F.when(number == 0, 0.0).otherwise(F.log2(F.abs(number)) + _SMALLEST)
    scaled = F.signum(number) * size * RANGES_PER_DOUBLING
    return F.floor(F.greatest(F.least(scaled, F.lit(1e9)), F.lit(-1e9)))


def _rank(p: float, floor: bool) -> Column:
    position = (F.col("_total") - 1) * F.lit(float(p))
    return F.floor(position) if floor else F.ceil(position)


def ticker_statistics(bars: DataFrame, key: str = "ticker") -> DataFrame:
    """Count, mean, sample deviation, extremes, quartiles and price-volume correlation per ticker."""
    plain = bars.groupBy(key).agg(
        F.count("*").alias("data_points"),
        F.avg("close").alias("avg_price"),
        F.stddev_samp("close").alias("price_volatility"),
        F.avg("volume").alias("avg_volume"),
        F.min("low").alias("min_price"),
        F.max("high").alias("max_price"),
        correlation(F.col("close"), F.col("volume")).alias("price_volume_correlation"),
    )
    quartiles = exact_quantiles(bars, key, "close", QUARTILES).withColumnRenamed(key, "_key")
    return plain.join(quartiles, plain[key].eqNullSafe(quartiles["_key"]), "left").drop("_key")


def daily_vwap(bars: DataFrame, key: str = "ticker", time: str = "window_start_et") -> DataFrame:
    """VWAP, volume and range per ticker and market day."""
    spread = F.max("high") - F.min("low")
    return bars.groupBy(key, F.to_date(time).alias("trade_date")).agg(
        vwap(F.col("close"), F.col("volume")).alias("vwap"),
        F.count("*").alias("data_points"),
        F.sum("volume").alias("total_volume"),
        F.min("low").alias("day_low"),
        F.max("high").alias("day_high"),
        F.try_divide(spread, F.avg("close")).alias("daily_range_pct"),
    )


def daily_closes(bars: DataFrame, key: str = "ticker", time: str = "window_start_et") -> DataFrame:
    """Mean close per ticker and market day."""
    return bars.groupBy(key, F.to_date(time).alias("trade_date")).agg(F.avg("close").alias("daily_close"))


def base_correlation(daily: DataFrame, base: str, key: str = "ticker") -> DataFrame:
    """Correlation of every other ticker's daily close with the base ticker's, on joint days.

    The base side has one row per day, so its size is bounded by the calendar.
    """
    reference = daily.filter(F.col(key) == base).select(
        "trade_date", F.col("daily_close").alias("base_close"))
    joint = daily.filter(F.col(key) != base).join(F.broadcast(reference), "trade_date")
    return joint.groupBy(key).agg(
        correlation(F.col("base_close"), F.col("daily_close")).alias("correlation"),
        F.count("*").alias("data_points"))


def pivot_closes(daily: DataFrame, tickers: list[str], key: str = "ticker") -> DataFrame:
    """One row per day with a column per listed ticker."""
    return daily.filter(F.col(key).isin(tickers)).groupBy("trade_date").pivot(key, tickers).agg(
        F.first("daily_close"))


def pivot_correlation(daily: DataFrame, tickers: list[str], base: str, key: str = "ticker") -> DataFrame:
    """Correlation with the base over a pivot; ``data_points`` counts days all tickers have."""
    wide = pivot_closes(daily, tickers, key)
    others = [t for t in tickers if t != base]
    complete = F.lit(True)
    for t in tickers:
        complete = complete & F.col(f"`{t}`").isNotNull()
    found = wide.agg(F.count(F.when(complete, 1)).alias("data_points"), *[
        correlation(F.col(f"`{base}`"), F.col(f"`{t}`")).alias(f"_c{i}") for i, t in enumerate(others)])
    rows = F.array(*[
        F.struct(F.lit(t).alias(key), F.col(f"_c{i}").alias("correlation")) for i, t in enumerate(others)])
    return found.select("data_points", F.inline(rows)).select(key, "correlation", "data_points")


def pair_correlation(daily: DataFrame, bases: list[str], key: str = "ticker") -> DataFrame:
    """Correlation of every ticker with each listed base ticker, in long form."""
    reference = daily.filter(F.col(key).isin(bases)).select(
        F.col(key).alias("base"), "trade_date", F.col("daily_close").alias("base_close"))
    # One row per base and day; its size as it turns out decides how the sides meet, whatever the list.
    joint = daily.join(reference, "trade_date").filter(F.col(key) != F.col("base"))
    return joint.groupBy("base", key).agg(
        correlation(F.col("base_close"), F.col("daily_close")).alias("correlation"),
        F.count("*").alias("data_points"))


def ticker_count(bars: DataFrame, key: str = "ticker", approximate: bool = False) -> DataFrame:
    """Number of distinct tickers."""
    if approximate:
        return bars.agg(F.approx_count_distinct(key).alias("tickers"))
    return bars.select(key).distinct().agg(F.count(key).alias("tickers"))
