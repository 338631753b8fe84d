"""The Parquet bar store, partitioned by ``year`` and ``ticker``."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase

import pandas as pd
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import DataNotFound, PartitionNotFound
from barloom.functions import paths
from barloom.plans.barquery import BarQuery
from barloom.session import path_exists
from barloom.sources.flatfiles import list_files
from barloom.sources.versions import Versions

log = logging.getLogger(__name__)

_EMPTY = "the store holds no partition"


class BarStore:
    """Read access to one store root.

    The layout is declared, so opening the store reads no footers, and listings
    use file names only. A store with versions is read at the live one, or at
    ``version``; other files in its folders are not seen.
    """

    def __init__(self, spark: SparkSession, root: str, layout: str = schemas.CLEAN_BAR, version: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = layout
        self.version = version

    def _live(self) -> tuple[Versions, int | None]:
        versions = Versions(self.spark, self.root)
        return versions, versions.latest() if self.version is None else self.version

    def _read(self, reader: DataFrameReader, versions: Versions, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.layout)
        return reader.option("basePath", versions.root).parquet(*files)

    def scan(self, ignore_missing: bool = False, ignore_corrupt: bool = False) -> DataFrame:
        """All bars, lazily. Unreadable or vanished files are skipped only on request."""
        if not path_exists(self.spark, self.root):
            raise DataNotFound(f"no store at {self.root}")
        reader = self.spark.read.schema(self.layout)
        if ignore_missing:
            reader = reader.option("ignoreMissingFiles", True)
        if ignore_corrupt:
            reader = reader.option("ignoreCorruptFiles", True)
        versions, number = self._live()
        return reader.parquet(self.root) if number is None else self._read(reader, versions, versions.paths(number))

    def scan_partitions(self, parts: list[tuple[int, str]]) -> DataFrame:
        """One read over listed ``(year, ticker)`` partitions; missing ones are logged and skipped."""
        wanted = self.spark.createDataFrame(parts, "year INT, ticker STRING")
        present = {
            (r.year, r.ticker)
            for r in self.partitions().join(F.broadcast(wanted), ["year", "ticker"], "left_semi").collect()
        }
        for part in sorted(set(parts) - present):
            log.warning("partition not found: year=%s ticker=%s", *part)
        if not present:
            raise PartitionNotFound(f"none of the partitions exists: {parts}")
        # Folder names are compared as partition values, in one lookup however many there are.
        keys = F.broadcast(self.spark.createDataFrame(sorted(present), "year INT, ticker STRING"))
        years = sorted({year for year, _ in present})
        return self.scan().where(F.col("year").isin(years)).join(keys, ["year", "ticker"], "left_semi")

    def scan_paths(self, folders: list[str], ignore_corrupt: bool = False) -> DataFrame:
        """One read over partition folders, such as those of ``BarQuery.partition_paths``.

        Folders that do not exist are logged and skipped. Prefer :meth:`get_bars`,
        whose predicates let Spark prune by itself.
        """
        reader = self.spark.read.schema(self.layout).option("ignoreCorruptFiles", ignore_corrupt)
        versions, number = self._live()
        if number is not None:
            wanted = [f"{versions.root}/{f.removeprefix(versions.root).removeprefix(self.root).lstrip('/')}/*" for f in folders]
            files = [p for p in versions.paths(number) if any(fnmatchcase(p, w) for w in wanted)]
            if not files:
                raise PartitionNotFound(f"none of the partitions exists: {folders}")
            return self._read(reader, versions, files)
        present = []
        for folder in folders:
            if "*" in folder or path_exists(self.spark, folder):
                present.append(folder)
            else:
                log.warning("partition not found: %s", folder)
        if not present:
            raise PartitionNotFound(f"none of the partitions exists: {folders}")
        return reader.option("basePath", self.root).parquet(*present)

    def get_bars(self, tickers=None, years=None, start_date=None, end_date=None, columns=None,
                 ordered: bool = False, require_rows: bool = False, exact_case: bool = False,
                 default_year: int | None = None) -> DataFrame:
        query = BarQuery.build(tickers, years, start_date, end_date, columns, exact_case, default_year)
        return query.apply(self.scan(), ordered, require_rows)

    def get_bars_sql(self, view: str = "barloom_bars", ordered: bool = False, **selection) -> DataFrame:
        """The same selection through SQL text with bound parameters."""
        self.scan().createOrReplaceTempView(view)
        return BarQuery.build(**selection).run_sql(self.spark, view, ordered)

    def stream_bars(self, chunk_size: int = 10_000, **selection) -> Iterator[pd.DataFrame]:
        """Pieces of at most ``chunk_size`` rows for a consumer on the driver.

        One partition is held at a time; use :func:`map_chunks` to work on executors.
        """
        return iter_chunks(self.get_bars(**selection), chunk_size)

    def files(self) -> DataFrame:
        versions, number = self._live()
        if number is None:
            listed = list_files(self.spark, self.root, "*.parquet")
        else:
            listed = versions.entries(number).withColumn("path", F.concat(F.lit(f"{versions.root}/"), "path"))
        return listed.select(
            paths.partition_value(F.col("path"), "year").cast("int").alias("year"),
            paths.partition_value(F.col("path"), "ticker").alias("ticker"),
            paths.partition_folder(F.col("path")).alias("path"),
            F.col("path").alias("file"),
            "length",
        ).filter(F.col("year").isNotNull() & F.col("ticker").isNotNull())

    def partitions(self, year: int | None = None, ticker: str | None = None) -> DataFrame:
        """``year, ticker, path, files, bytes``; the ticker filter ignores case."""
        found = self.files()
        if year is not None:
            found = found.filter(F.col("year") == year)
        if ticker is not None:
            found = found.filter(F.upper("ticker") == ticker.upper())
        return found.groupBy("year", "ticker", "path").agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def tickers(self, year: int | None = None) -> DataFrame:
        return self.partitions(year).select("ticker").distinct().orderBy("ticker")

    def years(self) -> DataFrame:
        return self.files().select("year").distinct().orderBy("year")

    def exists(self, year: int, ticker: str) -> bool:
        return not self.partitions(year, ticker).isEmpty()

    def stored_tickers(self) -> DataFrame:
        """``year, ticker`` with at least one file; empty if there is no store yet."""
        try:
            return self.partitions().select("year", "ticker")
        except DataNotFound:
            return self.spark.createDataFrame([], "year INT, ticker STRING")

    def health(self) -> DataFrame:
        """One row of store facts with the list of issues found.

        Files that the reader cannot open are an issue each, and their rows are not counted.
        """
        from barloom.plans.maintain import corrupt_files

        try:
            bars = self.scan(ignore_corrupt=True)
            listing = self.partitions().agg(F.count("*").alias("partitions"), F.sum("files").alias("files"))
        except DataNotFound:
            return self.spark.sql(
                f"SELECT 'unhealthy' AS status, 0L AS partitions, 0L AS files, 0L AS rows, 0L AS null_keys, "
                "0L AS duplicate_keys, CAST(NULL AS TIMESTAMP_NTZ) AS first_bar, "
                f"CAST(NULL AS TIMESTAMP_NTZ) AS last_bar, array('{_EMPTY}') AS issues")
        unreadable = corrupt_files(self.spark, self.root, layout=self.layout).agg(
            F.array_sort(F.collect_list(F.concat(F.lit("unreadable file "), F.col("path")))).alias("unreadable"))
        profile = profile_bars(bars).select(
            "*", listing.select("partitions").scalar().alias("partitions"),
            listing.select("files").scalar().alias("files"), unreadable.scalar().alias("unreadable"))
        return profile.select(
            F.when((F.col("null_keys") == 0) & (F.col("duplicate_keys") == 0) & (F.col("partitions") > 0)
                   & (F.size("unreadable") == 0), "healthy").otherwise("unhealthy").alias("status"),
            "partitions", "files", "rows", "null_keys", "duplicate_keys", "first_bar", "last_bar",
            F.concat(F.array_compact(F.array(
                F.when(F.col("partitions") == 0, _EMPTY),
                F.when(F.col("null_keys") > 0, "some bars lack a ticker or a time"),
                F.when(F.col("duplicate_keys") > 0, "a ticker and time has more than one bar"),
            )), F.col("unreadable")).alias("issues"),
        )


def profile_bars(bars: DataFrame) -> DataFrame:
    """Rows, null keys, surplus rows per key and time span of a bar table."""
    per_key = bars.groupBy("ticker", "window_start_et").agg(F.count("*").alias("n"))
    missing = F.col("ticker").isNull() | (F.col("ticker") == "") | F.col("window_start_et").isNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(~missing, F.col("n") - 1)), F.lit(0)).alias("duplicate_keys"),
        F.min("window_start_et").alias("first_bar"),
        F.max("window_start_et").alias("last_bar"),
    )


def iter_chunks(df: DataFrame, chunk_size: int) -> Iterator[pd.DataFrame]:
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == chunk_size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def map_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
               chunk_size: int = 10_000) -> DataFrame:
    """Apply ``fn`` on executors to pieces of at most ``chunk_size`` rows."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            while count + len(batch) >= chunk_size:
                cut = chunk_size - count
                held.append(batch.iloc[:cut])
                yield fn(pd.concat(held, ignore_index=True))
                batch, held, count = batch.iloc[cut:], [], 0
            if len(batch):
                held.append(batch)
                count += len(batch)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return df.mapInPandas(pieces, schema)
