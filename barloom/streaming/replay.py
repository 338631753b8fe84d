"""Replay of stored bars in time order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import bar_start
from barloom.streaming.manifest import land_by_time, read_manifest_stream

ORDER = ["window_start_et", "ticker"]


def next_bars(bars: DataFrame) -> Iterator[Row]:
    """Bars one by one in time order for a driver-side consumer, one partition at a time."""
    return bars.orderBy(*ORDER).toLocalIterator(prefetchPartitions=True)


def stage_replay(bars: DataFrame, path: str, timespan: str = "day") -> int:
    """Land bars by period, oldest first, and give the number of periods.

    All periods are written by one job, each as several sorted files if it is
    large. Bars without a time are the first period.
    """
    period = F.date_format(bar_start(F.col("window_start_et"), 1, timespan), "yyyy-MM-dd")
    return land_by_time(bars, path, period, ORDER)


def replay_stream(spark: SparkSession, path: str, layout: str, periods_per_batch: int = 1, progress: str | None = None) -> DataFrame:
    """Stream of a staged replay, ``periods_per_batch`` periods per micro-batch; see :func:`read_manifest_stream`."""
    return read_manifest_stream(spark, path, layout, periods_per_batch, progress)
