"""The daily flat-file load into the bar store."""

from __future__ import annotations

import argparse
import logging
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameWriter, Observation, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import clock, paths
from barloom.session import broadcast_if_counted, build_session, observed, settled
from barloom.sources.barstore import BarStore
from barloom.sources.flatfiles import read_raw_bars, require_columns
from barloom.sources.versions import Versions

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class IngestReport:
    rows_written: int
    tickers_written: int
    rows_rejected: int = 0


def valid_rows(raw: DataFrame) -> DataFrame:
    """Rows with a ticker and a time."""
    return raw.filter(_is_valid())


def rejected_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(~_is_valid())


def _is_valid():
    return F.coalesce(F.col("ticker") != "", F.lit(False)) & F.col("window_start").isNotNull()


def with_market_time(raw: DataFrame) -> DataFrame:
    """Replace epoch nanoseconds by the New York wall clock and add its year."""
    timed = raw.withColumn("window_start_et", clock.market_from_epoch(F.col("window_start"), "ns"))
    return timed.withColumn("year", F.year("window_start_et")).drop("window_start")


def trading_hours_only(bars: DataFrame, time: str = "window_start_et") -> DataFrame:
    """Bars from 09:30 to before 16:00, Monday to Friday."""
    return bars.filter(clock.is_weekday(F.col(time)) & clock.in_trading_hours(F.col(time)))


def clean_bars(raw: DataFrame, year: int | None = None) -> DataFrame:
    """Raw to clean bars; ``year`` keeps one market-time year."""
    require_columns(raw, schemas.RAW_BAR_COLUMNS)
    bars = trading_hours_only(with_market_time(valid_rows(raw)))
    if year is not None:
        bars = bars.filter(F.col("year") == year)
    return bars.select(*schemas.CLEAN_BAR_COLUMNS)


def without_stored(bars: DataFrame, stored: DataFrame) -> DataFrame:
    """Bars whose (year, ticker) is not stored yet."""
    return bars.join(broadcast_if_counted(stored), ["year", "ticker"], "left_anti")


def write_bars(bars: DataFrame, root: str, mode: str = "append",
               partition_by: tuple[str, ...] = ("year", "ticker"), time: str = "window_start_et",
               compression: str = "snappy", max_rows_per_file: int = 0) -> None:
    """Write a partitioned store, one sorted file per partition of normal size.

    Rows are rebalanced by partition, so a partition beyond the advisory size is
    split over several tasks and files instead of passing through one.
    ``overwrite`` replaces only the partitions present in ``bars``. In a store
    with versions the new files go live together, as its next version.
    """
    keys = list(partition_by)
    writer = bars.hint("rebalance", *keys).sortWithinPartitions(*keys, time).write \
        .option("partitionOverwriteMode", "dynamic").option("compression", compression)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    versions = Versions(bars.sparkSession, root)
    parent = versions.latest()
    if parent is None:
        writer.mode(mode).partitionBy(*keys).parquet(root)
    else:
        publish(versions, parent, written_beside(versions, writer.partitionBy(*keys)), replace=mode == "overwrite")


def written_beside(versions: Versions, writer: DataFrameWriter) -> DataFrame:
    """Add the writer's files to the folders of a store without making them live; their entries."""
    tag = f"part-{uuid.uuid4().hex}"
    writer.mode("append").option("mapreduce.output.basename", tag).parquet(versions.root)
    return settled(versions.present(f"{tag}-*.parquet"), "entries")


def publish(versions: Versions, parent: int, added: DataFrame, replace: bool) -> int:
    """A version of the parent's files and the added ones; with ``replace`` without the parent's files in their folders."""
    old = versions.entries(parent)
    if replace:
        folder = paths.partition_folder(F.col("path"))
        old = old.withColumn("_folder", folder).join(added.select(folder.alias("_folder")).distinct(), "_folder", "left_anti").drop("_folder")
    return versions.commit(old.union(added), parent)


def write_bars_by_date(bars: DataFrame, root: str, mode: str = "append",
                       time: str = "window_start_et") -> None:
    """A store partitioned by market day and sorted by ticker, for whole-market queries."""
    dated = bars.withColumn("trade_date", F.to_date(time))
    dated.hint("rebalance", "trade_date").sortWithinPartitions("trade_date", "ticker", time) \
        .write.mode(mode).option("partitionOverwriteMode", "dynamic") \
        .partitionBy("trade_date").parquet(root)


def write_indexed(bars: DataFrame, root: str, mode: str = "append",
                  time: str = "window_start_et") -> None:
    """A searchable store without ticker folders: files range over ticker and time, so that
    row-group statistics find a ticker; strongly compressed."""
    bars.repartitionByRange("ticker", time).sortWithinPartitions("ticker", time) \
        .write.mode(mode).option("compression", "zstd").parquet(root)


def ingest_bars(spark: SparkSession, source: str | list[str], root: str, year: int | None = None,
                tickers: list[str] | None = None, mode: str = "append", quarantine: str | None = None,
                **read_options) -> IngestReport:
    """Load flat files into the store; tickers already stored for a year are left alone.

    Running it again on the same input writes nothing. ``quarantine`` names a
    folder that receives the rows without ticker or time; a later load of the
    same kind replaces it. The report is observed while the rows are written.
    """
    raw = read_raw_bars(spark, source, tickers=tickers, **read_options)
    seen, added = Observation(), Observation()
    if quarantine:
        rejected_rows(raw).write.mode("overwrite").parquet(quarantine)
    watched = raw.observe(seen, F.count_if(~_is_valid()).alias("rejected"))
    # Listed now, so it stays the state before the load. Its size is that of the file names, not of the files.
    stored = settled(BarStore(spark, root).stored_tickers(), "stored")
    new = without_stored(clean_bars(watched, year), stored)
    write_bars(new.observe(added, F.count(F.lit(1)).alias("rows"), F.collect_set("ticker").alias("tickers")), root, mode)
    written, read = observed(added, rows=0, tickers=[]), observed(seen, rejected=0)
    report = IngestReport(written["rows"], len(written["tickers"]), read["rejected"])
    log.info("ingest: %s", report)
    return report


def ingest_day_files(spark: SparkSession, source: str | list[str], root: str,
                     tickers: list[str] | None = None, timeframe: str = "1-min",
                     **read_options) -> None:
    """Load into a store by ``year, timeframe, ticker, trade_date``; loading a day again replaces it."""
    bars = trading_hours_only_any_day(with_market_time(valid_rows(
        read_raw_bars(spark, source, tickers=tickers, **read_options))))
    dated = bars.withColumn("timeframe", F.lit(timeframe)).withColumn(
        "trade_date", F.to_date("window_start_et"))
    write_bars(dated, root, "overwrite", ("year", "timeframe", "ticker", "trade_date"))


def trading_hours_only_any_day(bars: DataFrame, time: str = "window_start_et") -> DataFrame:
    """Bars from 09:30 to before 16:00 on every weekday and weekend day present."""
    return bars.filter(clock.in_trading_hours(F.col(time)))


def main(argv: list[str] | None = None) -> None:
    """``spark-submit .../ingest.py SOURCE ROOT [--year Y] [--tickers A,B] [--quarantine DIR]``"""
    parser = argparse.ArgumentParser(description="Load daily flat files into the bar store.")
    parser.add_argument("source")
    parser.add_argument("root")
    parser.add_argument("--year", type=int)
    parser.add_argument("--tickers")
    parser.add_argument("--quarantine")
    args = parser.parse_args(argv)
    print(ingest_bars(
        build_session("barloom-ingest"), args.source, args.root, args.year,
        args.tickers.split(",") if args.tickers else None, quarantine=args.quarantine))


if __name__ == "__main__":
    main()
