"""One-row-per-ticker market snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.ratios import change_percent, vwap
from barloom.operators.bars import aggregate_bars
from barloom.operators.daily import with_previous_close
from barloom.operators.rows import latest_row


def last_trade(trades: DataFrame, key: str = "ticker", time: str = "ts",
               sequence: str = "sequence") -> DataFrame:
    return latest_row(trades, [key], [time, sequence])


def last_quote(quotes: DataFrame, key: str = "ticker", time: str = "ts",
               sequence: str = "sequence") -> DataFrame:
    return latest_row(quotes, [key], [time, sequence])


def ticker_snapshot(bars: DataFrame, trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Latest day, previous day, last minute, last trade and last quote as nested structs.

    A ticker is listed if it has any of them.
    """
    # One pass over the bars: days, each with its last minute.
    minute = F.struct(*[c for c in bars.columns if c != "ticker"])
    daily = bars.groupBy("ticker", F.to_date("window_start_et").alias("trade_date")).agg(
        F.min_by("open", "window_start_et").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "window_start_et").alias("close"),
        F.sum("volume").alias("volume"), vwap(F.col("vwap"), F.col("volume")).alias("vwap"),
        F.sum("transactions").alias("transactions"), F.max_by(minute, "window_start_et").alias("min"))
    day = F.struct("trade_date", "open", "high", "low", "close", "volume", "vwap", "transactions")
    before = F.lag(day).over(W.partitionBy("ticker").orderBy("trade_date"))
    days = latest_row(
        daily.select("ticker", "trade_date", day.alias("day"), before.alias("prev_day"), "min"),
        ["ticker"], ["trade_date"])
    trade, quote = last_trade(trades), last_quote(quotes)
    trade = trade.select("ticker", F.struct(*[c for c in trade.columns if c != "ticker"]).alias("last_trade"))
    quote = quote.select("ticker", F.struct(*[c for c in quote.columns if c != "ticker"]).alias("last_quote"))
    out = days.join(trade, "ticker", "full").join(quote, "ticker", "full")
    return out.select(
        "ticker", "day", "prev_day", "min", "last_trade", "last_quote",
        (F.col("last_trade.price") - F.col("prev_day.close")).alias("todays_change"),
        change_percent(F.col("last_trade.price"), F.col("prev_day.close")).alias("todays_change_percent"),
        F.greatest("last_trade.ts", "last_quote.ts").alias("updated"),
    )


def previous_close(bars: DataFrame) -> DataFrame:
    """Daily bars with the previous day's close and the change against it."""
    daily = aggregate_bars(bars, 1, "day").withColumn("trade_date", F.to_date("bar_start"))
    return with_previous_close(daily)
