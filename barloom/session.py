"""Session settings and the shared working folder."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.errors import ConfigurationError

log = logging.getLogger(__name__)

# Joins hint a broadcast only below this counted size; above it the join stays
# a shuffle join, which adaptive execution splits when a key is skewed.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only when the setting is absent and the
    master is local, because executors elsewhere could not see it; it is made
    once and then named by the session's setting.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/barloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_dir(spark: SparkSession, label: str) -> Iterator[str]:
    """A :func:`work_dir` whose files go when the block ends."""
    folder = work_dir(spark, label)
    try:
        yield folder
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: done once, and not repeated when an executor is lost."""
    target = work_dir(df.sparkSession, label)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def observed(metrics: Observation, **if_empty):
    """What was observed; ``if_empty`` where adaptive execution found the input empty and left the observation out."""
    try:
        return metrics.get
    except Py4JJavaError as error:
        if "AssertionError" not in str(error.java_exception):
            raise
        return if_empty


def counted_bytes(df: DataFrame) -> int:
    """Bytes of a settled table in memory: rows times the width of a row, with text as long as it is."""
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) for f in df.schema):
        raise ConfigurationError("only tables of plain columns are counted")
    sums = df.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in text]).first()
    return sums[0] * (16 + 16 * len(df.columns)) + sum(sums[1:])


def broadcast_if_counted(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast of a settled table whose counted size allows it, else leave the join to adaptive execution.

    File sizes and plan estimates are no measure: compressed text can be a thousand times as large in memory.
    """
    return F.broadcast(df) if counted_bytes(df) <= limit else df


def steering(df: DataFrame, label: str) -> DataFrame:
    """The small side of a join that steers a large one, such as counts per cell.

    It is always settled, whatever its size, and broadcast if its counted size
    allows; otherwise the join is a shuffle join.
    """
    return broadcast_if_counted(settled(df, label))
