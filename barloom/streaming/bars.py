"""Bars and running day totals from a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.ratios import vwap
from barloom.operators.bars import in_sequence
from barloom.streaming.events import market_time


def stream_bars(trades: DataFrame, size: str = "1 minute", delay: str | None = "1 minute") -> DataFrame:
    """Bars per symbol and event-time window.

    With ``delay`` a watermark is set: append mode then emits each bar once it is
    closed, and later trades are dropped and counted by Spark. Pass None if the
    input already carries one.
    """
    timed = trades.withWatermark("event_time", delay) if delay else trades
    first = in_sequence(F.col("timestamp"), F.col("sequence_number"))
    grouped = timed.groupBy("symbol", F.window("event_time", size).alias("w")).agg(
        F.min_by("price", first).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", first).alias("close"),
        F.sum("size").alias("volume"),
        F.count("*").alias("transactions"),
        vwap(F.col("price"), F.col("size")).alias("vwap"),
        F.avg("size").alias("average_size"),
    )
    return grouped.select(
        "symbol", market_time("w.start").alias("window_start_et"),
        "open", "high", "low", "close", "volume", "transactions", "vwap", "average_size")


def stream_day_totals(trades: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """Day volume and VWAP so far per symbol, for update mode."""
    timed = trades.withWatermark("event_time", delay) if delay else trades
    return timed.groupBy("symbol", F.to_date(market_time("event_time")).alias("trade_date")).agg(
        F.sum("size").alias("accumulated_volume"),
        vwap(F.col("price"), F.col("size")).alias("aggregate_vwap"),
        F.count("*").alias("transactions"),
    )
