"""Stored rows as a stream in time order, batch by batch along a manifest.

Rows are landed in one job, range-partitioned by period and time, so a period is
as many sorted files as its rows need. The manifest numbers the files in that
order; it is the version table of the folder, so new files appear together or
not at all. The stream's offsets are positions in the manifest: a micro-batch is
a run of whole periods, and a restart goes on at the position where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.errors import DataNotFound
from barloom.functions import paths
from barloom.session import settled
from barloom.sources.versions import FOLDER, Versions

PERIOD = "_period"
# The period of rows without a time; it sorts before every date.
UNTIMED = "-"
MANIFEST = "path STRING, length BIGINT, position BIGINT, period STRING"
_ROWS_PER_READ = 64 * 1024


def land_by_time(rows: DataFrame, path: str, period: Column, order: list[str]) -> int:
    """Write ``rows`` as the next periods of the manifest at ``path``; how many periods that are.

    ``period`` is a text that sorts by time, NULL for rows without one, which
    come first. Files follow one another in ``order``. Rows landed earlier keep
    their positions: an older period landed late comes after them.
    """
    spark = rows.sparkSession
    dated = rows.withColumn(PERIOD, F.coalesce(period, F.lit(UNTIMED)))
    versions = Versions(spark, path)
    parent, tag = versions.latest(), f"part-{uuid.uuid4().hex}"
    dated.repartitionByRange(PERIOD, *order).sortWithinPartitions(PERIOD, *order).write.mode("append").option(
        "mapreduce.output.basename", tag).partitionBy(PERIOD).parquet(path)
    held = None if parent is None else versions.entries(parent, MANIFEST)
    offset = 0 if held is None else held.agg(F.coalesce(F.max("position") + 1, F.lit(0))).first()[0]
    # The number of the task that wrote a file is its place in the range order.
    part = F.regexp_extract("path", rf"{tag}-(\d+)-", 1).cast("bigint")
    named = versions.present(f"{tag}-*.parquet").withColumn("period", paths.partition_value(F.concat(F.lit("/"), "path"), PERIOD)).withColumn(
        "position", F.row_number().over(W.orderBy("period", part, "path")) - 1 + offset)
    named = settled(named.select("path", "length", "position", "period"), "manifest")
    versions.commit(named if held is None else held.unionByName(named), parent)
    return named.select("period").distinct().count()


def read_manifest_stream(spark: SparkSession, path: str, layout: str, periods_per_batch: int = 0,
                         progress: str | None = None) -> DataFrame:
    """Stream of the rows landed at ``path``, by default all that is there per micro-batch.

    With ``periods_per_batch`` a batch takes that many periods at most, and
    ``progress`` names a file, one per query, that tells a restarted query how far
    it had planned. A folder that is reached through pyarrow's file systems
    (local, S3, HDFS, GCS) can be streamed.
    """
    # A name of its own per session: the check for taken names also looks into the active one.
    name = f"{ManifestSource.name()}_{spark._jsparkSession.sessionUUID().replace('-', '')}"
    spark.dataSource.register(type("SessionManifest", (ManifestSource,), {"name": classmethod(lambda cls: name)}))
    reader = spark.readStream.format(name).schema(layout).option("path", Versions(spark, path).root)
    if periods_per_batch:
        reader = reader.option("periodsPerBatch", str(periods_per_batch)).option("progress", progress or f"{path}/_progress")
    return reader.load()


class ManifestSource(DataSource):
    """``format("barloom_manifest")`` with ``path``, ``periodsPerBatch`` and ``progress``."""

    @classmethod
    def name(cls) -> str:
        return "barloom_manifest"

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return ManifestReader(self.options, schema)


class Stretch(InputPartition):
    """One file."""

    def __init__(self, path: str):
        super().__init__(path)


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    if uri.startswith("file://"):
        uri = "/" + uri.removeprefix("file://").lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class ManifestReader(DataSourceStreamReader):
    def __init__(self, options, schema: T.StructType):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("periodsPerBatch", 0))
        self.progress = options.get("progress")
        self.schema = schema
        self.planned: int | None = None

    def _entries(self) -> list[dict]:
        """The live manifest, in order."""
        system, root = _opened(f"{self.path}/{FOLDER}")
        found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        for marker in sorted((f for f in found if f.base_name.isdigit() and f.size), key=lambda f: f.base_name, reverse=True):
            with system.open_input_stream(marker.path) as stream:
                name = stream.read().decode()
            table = pq.read_table(f"{root}/{name}", filesystem=system, columns=["position", "period", "path"])
            return table.sort_by("position").to_pylist()
        raise DataNotFound(f"{self.path} has no manifest")

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        """The end of the next periods. A new reader first repeats what was planned last, which may not have been run."""
        entries = self._entries()
        end = entries[-1]["position"] + 1 if entries else 0
        if not self.limit:
            return {"position": end}
        if self.planned is None:
            self.planned = self._saved()
            if self.planned is not None:
                return {"position": self.planned}
            self.planned = 0
        rest = [e for e in entries if e["position"] >= self.planned]
        periods: list[str] = []
        for entry in rest:
            if not periods or entry["period"] != periods[-1]:
                if len(periods) == self.limit:
                    break
                periods.append(entry["period"])
            self.planned = entry["position"] + 1
        if rest:
            system, path = _opened(self.progress)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as stream:
                stream.write(str(self.planned).encode())
        return {"position": self.planned}

    def _saved(self) -> int | None:
        system, path = _opened(self.progress)
        if system.get_file_info(path).type == pafs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as stream:
            return int(stream.read())

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(f"{self.path}/{e['path']}") for e in self._entries() if start["position"] <= e["position"] < end["position"]]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.schema)
        system, path = _opened(partition.value)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(_ROWS_PER_READ, columns=wanted.names, use_threads=False):
                columns = [_typed(batch.column(f.name), f.type) for f in wanted]
                yield pa.RecordBatch.from_arrays(columns, schema=wanted)


def _typed(column: pa.Array, kind: pa.DataType) -> pa.Array:
    """Times as Spark counts them: microseconds, in UTC where they are instants."""
    if pa.types.is_timestamp(kind) and pa.types.is_timestamp(column.type) and column.type != kind:
        return column.cast(pa.timestamp("us"), safe=False).cast(kind)
    return column.cast(kind)
