"""Store maintenance: compaction, detection and repair of unreadable files."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import DataNotFound, DataValidationError
from barloom.functions import paths
from barloom.operators.rows import distinct_rows
from barloom.plans.ingest import clean_bars, publish, write_bars, written_beside
from barloom.session import observed, path_exists, scratch_dir
from barloom.sources.barstore import BarStore
from barloom.sources.flatfiles import read_raw_bars
from barloom.sources.versions import Versions

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CompactionReport:
    files_before: int
    files_after: int
    rows_before: int
    rows_after: int


def compact(spark: SparkSession, root: str, year: int | None = None, tickers: list[str] | None = None,
            layout: str = schemas.CLEAN_BAR,
            partition_by: tuple[str, ...] = ("year", "ticker"), keep_versions: int = 1) -> CompactionReport:
    """Drop duplicate rows and merge the files of each partition.

    New files are written beside the old ones and their rows counted again; then
    one commit makes them live in all partitions at once. A failure before it
    leaves the old version as it was, whatever was written. A store without
    versions gets its first here. The last ``keep_versions`` versions stay
    readable; files that none of them names are deleted at the end.
    """
    def chosen(df: DataFrame) -> DataFrame:
        if year is not None:
            df = df.filter(F.col("year") == year)
        return df.filter(F.col("ticker").isin(tickers)) if tickers is not None else df

    if not path_exists(spark, root):
        raise DataNotFound(f"no store at {root}")
    versions = Versions(spark, root)
    parent = versions.adopt()
    store = BarStore(spark, root, layout, parent)
    picked = chosen(store.scan())
    files_before = chosen(store.files()).count()
    rows_before = picked.count()
    if rows_before == 0:
        raise DataNotFound(f"nothing to compact in {root}")
    counted = Observation("compact")
    merged = distinct_rows(picked).observe(counted, F.count(F.lit(1)).alias("rows"))
    keys = list(partition_by)
    added = written_beside(versions, merged.hint("rebalance", *keys).sortWithinPartitions(*keys, "window_start_et").write.partitionBy(*keys))
    rows_after = observed(counted, rows=0)["rows"]
    files = [f"{versions.root}/{r.path}" for r in added.select("path").collect()]
    if spark.read.schema(layout).option("basePath", versions.root).parquet(*files).count() != rows_after:
        raise DataValidationError("written rows differ from the distinct rows; store left unchanged")
    publish(versions, parent, added, replace=True)
    versions.vacuum(keep_versions)
    return CompactionReport(files_before, chosen(BarStore(spark, root, layout).files()).count(), rows_before, rows_after)


def corrupt_files(spark: SparkSession, root: str, deep: bool = False, layout: str = schemas.CLEAN_BAR) -> DataFrame:
    """``path, ticker, year, error`` of files below ``root`` that are not readable as Parquet.

    Spark's own reader decides, so any file system and any path it can read work
    here. The row counts of all footers are taken with unreadable files passed
    over; ``deep`` also decodes every column and compares the counts. A file that
    misses is then read byte by byte: if that fails, the place is at fault, not
    the format, and the job stops with that error. Files without rows are healthy.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(root).select("path", F.col("_metadata.file_path").alias("_file"))
    versions = Versions(spark, root)
    if (number := versions.latest()) is not None:
        # Files that no longer belong to the store, or not yet, are not its damage.
        listed = listed.join(versions.entries(number).select(F.concat(F.lit(f"{versions.root}/"), "path").alias("path")), "path", "left_semi")
    files = spark.read.schema(layout).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").parquet(root)
    by_file = files.groupBy(F.col("_metadata.file_path").alias("_file"))
    seen = listed.join(by_file.agg(F.count(F.lit(1)).alias("rows")), "_file", "left").withColumn("decoded", F.col("rows"))
    if deep:
        decoded = by_file.agg(F.count(F.lit(1)).alias("decoded"), F.bit_xor(F.xxhash64(*files.columns)).alias("_all"))
        seen = seen.drop("decoded").join(decoded.where("_all IS NOT NULL"), "_file", "left")
    suspects = [tuple(r) for r in seen.where("rows IS NULL OR NOT decoded <=> rows").select("path", "rows", "decoded").collect()]
    if suspects:
        # Raises where the bytes themselves cannot be had.
        spark.read.text([path for path, *_ in suspects]).agg(F.sum(F.length("value"))).collect()
    bad = [(path, f"{decoded or 0} of {rows} rows can be decoded") for path, rows, decoded in suspects if rows is not None]
    bad += _unreadable(spark, [path for path, rows, _ in suspects if rows is None])
    return spark.createDataFrame(bad, "path STRING, error STRING").select(
        "path", paths.partition_value(F.col("path"), "year").cast("int").alias("year"),
        paths.partition_value(F.col("path"), "ticker").alias("ticker"), "error")


def _unreadable(spark: SparkSession, suspects: list[str]) -> list[tuple[str, str]]:
    """(path, error) of the suspects that the reader objects to; the others are healthy but empty.

    Suspects are read together and halved where that fails: one job if all are
    healthy, about two times the logarithm of their number for each broken one.
    """
    if not suspects or (error := _reader_error(spark, suspects)) is None:
        return []
    if len(suspects) == 1:
        return [(suspects[0], error)]
    half = len(suspects) // 2
    return _unreadable(spark, suspects[:half]) + _unreadable(spark, suspects[half:])


def _reader_error(spark: SparkSession, files: list[str]) -> str | None:
    """What the reader says about files whose bytes can be had; None if it reads them all."""
    try:
        spark.read.option("ignoreCorruptFiles", False).parquet(*files).count()
    except (PySparkException, Py4JJavaError) as error:
        # Its bytes could be had, so the reader objects to the format.
        return str(error.java_exception.getMessage() if isinstance(error, Py4JJavaError) else error)
    return None


def repair(spark: SparkSession, root: str, source: str | list[str], deep: bool = False,
           **read_options) -> DataFrame:
    """Rebuild the (year, ticker) partitions that hold unreadable files.

    A broken partition is replaced as a whole by its readable rows and those of
    the flat files, each row once; others are not touched. Gives the broken
    ``year, ticker`` pairs with ``rebuilt``: false where the flat files hold no
    bar of the pair, and then its files are left as they are.
    """
    broken = corrupt_files(spark, root, deep).select("year", "ticker").distinct()
    pairs = spark.createDataFrame(broken.collect(), broken.schema)
    if pairs.isEmpty():
        return pairs.withColumn("rebuilt", F.lit(True))
    fresh = clean_bars(read_raw_bars(spark, source, **read_options)).join(pairs, ["year", "ticker"], "left_semi")
    backed = fresh.select("year", "ticker").distinct()
    readable = BarStore(spark, root).scan(ignore_corrupt=True).join(pairs, ["year", "ticker"], "left_semi").join(
        backed, ["year", "ticker"], "left_semi")
    with scratch_dir(spark, "repair") as staging:
        distinct_rows(fresh.select(*readable.columns).union(readable)).write.parquet(staging)
        staged = spark.read.schema(readable.schema).parquet(staging)
        rebuilt = staged.select("year", "ticker", F.lit(True).alias("rebuilt")).distinct().collect()
        write_bars(staged, root, "overwrite")
    done = spark.createDataFrame(rebuilt, "year INT, ticker STRING, rebuilt BOOLEAN")
    return pairs.join(done, ["year", "ticker"], "left").select("year", "ticker", F.coalesce("rebuilt", F.lit(False)).alias("rebuilt"))
