"""Running streams to a table, with a user callback or an upsert per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from barloom.operators.rows import latest_row


def run_callback(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                 mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Call ``handle(batch, batch_id)`` for each micro-batch; restarts resume from ``checkpoint``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a stream to Parquet files, until the input is drained."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(writer: DataStreamWriter) -> StreamingQuery:
    """Run a query until its input is used up, then stop it; for sources that are taken a stretch at a time."""
    query = writer.trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
        done = None
        # A restarted source first repeats the offset it had planned, which may look like its end.
        while done != (last := (query.lastProgress or {}).get("batchId")):
            done = last
            query.processAllAvailable()
    finally:
        query.stop()
    return query


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append of a stream to Parquet files, batch by batch until its input is used up."""
    return drained(stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint))


def drain_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """:func:`upsert_versions` batch by batch until the input is used up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return drained(stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write))


def state_rows(query: StreamingQuery) -> list[dict]:
    """Per finished batch and stateful step: rows held, rows dropped as late, and bytes."""
    return [{"batch": p["batchId"], "step": i, "rows": op["numRowsTotal"], "late": op["numRowsDroppedByWatermark"], "bytes": op["memoryUsedBytes"]}
            for p in query.recentProgress for i, op in enumerate(p["stateOperators"])]


def late_rows(stream: DataFrame, time: str, delay: str, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that come behind the watermark to ``path/late``.

    A row is late if its ``time`` is no later than the latest time of all earlier
    batches less the delay. Running totals leave out exactly these; Spark's own
    stateful steps drop those of them that are a batch later still. Run it over the same source, in the same stretches,
    as the query whose loss it keeps. Each batch keeps its latest time in
    ``path/seen``, so a batch run again finds the same rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{path}/seen/batch_id={batch_id}")
        seen = spark.read.schema("latest TIMESTAMP, batch_id BIGINT").parquet(f"{path}/seen").where(F.col("batch_id") < batch_id)
        mark = seen.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).cast("string")).first()[0]
        batch.where(F.col(time) <= F.lit(mark).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")

    return drained(stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write))


def upsert_versions(stream: DataFrame, path: str, checkpoint: str,
                    available_now: bool = True) -> StreamingQuery:
    """Keep every batch's changed rows under its batch number; a batch run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_callback(stream, write, checkpoint, "update", available_now)


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key written by :func:`upsert_versions`."""
    return latest_row(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def batch_sizes(path: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(path).groupBy("batch_id").agg(F.count("*").alias("rows"))
