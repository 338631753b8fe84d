"""Sharding by sampled splitters.

A sample of keys, drawn with a chance in proportion to each row's size, gives
quantile boundaries that cut the key space into ranges of about equal bytes. A
key is a hash of the text, so equal texts lie together. Ranges that turn out
overfull, because one text holds more than a range, are subdivided: such a text
gets ranges of its own, split by a hash of the row. Prefix sums over the ranges
and inside each range then place every row exactly, so shard sizes do not carry
the sampling error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import settle, text_of

RANGES_PER_SHARD = 32
ROWS_PER_RANGE = 200_000
MOST_RANGES = 100_000
KEYS_PER_RANGE = 16
KEEP_TOGETHER = 0.05


def _splitters(sized: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Quantile boundaries of a size-weighted key sample of about ``ranges * KEYS_PER_RANGE`` keys.

    A row larger than the sampling step is always drawn and counts as often as the step fits into it.
    """
    step = max(1, total // (ranges * KEYS_PER_RANGE))
    dice = F.pmod(F.xxhash64("key", "id", F.lit(17)), F.lit(step))
    drawn = sized.select("key", F.expr(f"size div {step}").alias("whole"), (F.expr(f"size % {step}") > dice).cast("long").alias("rest"))
    # At most total / step + rows drawn by chance: about ranges * KEYS_PER_RANGE entries, summed by key.
    sample = drawn.withColumn("n", F.col("whole") + F.col("rest")).where("n > 0").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    if not sample.num_rows:
        return np.empty(0, np.int64)
    weight = sample["n"].to_numpy().cumsum()
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges)
    return np.unique(sample["key"].to_numpy()[cuts])


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8,
                   ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text plus ``overhead``; null counts as
    empty. Shards are contiguous in key order and differ by the rounding at
    their edges. Rows of equal text stay in one shard unless the text holds more
    than ``KEEP_TOGETHER`` of a shard; then its rows fill shards in order. Slots
    number the rows of a shard from 0 without gaps. ``grown_shard`` is null,
    because sizes decide the place. Null and repeated ids are rows like any
    other; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = text_of(text_col)
    sized = settle(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    # Splitters and range totals stay within MOST_RANGES rows; the ranges of a larger table only hold more rows each.
    ranges = min(MOST_RANGES, max(shards * ranges_per_shard, sized.count() // ROWS_PER_RANGE))
    target = max(1, total // ranges)
    cuts = _splitters(sized, total, ranges)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.searchsorted(cuts, batch.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number.astype(np.int32))], names=[*batch.schema.names, "range"])

    # Texts with more bytes than a range: fewer than total / target, that is about the number of ranges.
    heavy = settle(sized.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > target), "heavy").select(
        "key", F.ceil(F.col("bytes") / target).cast("int").alias("parts"))
    placed_keys = sized.mapInArrow(ranged, T.StructType([*sized.schema, T.StructField("range", T.IntegerType())]))
    cells = placed_keys.join(F.broadcast(heavy), "key", "left")
    # Order of cells: (range, own, own key, part). A heavy text follows the light texts of its range.
    cells = cells.select("id", "size", "crc", "key", "row", "range",
                         F.when(F.col("parts").isNotNull(), F.col("key")).alias("own"),
                         F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0)).alias("part"))
    # Light texts of a range may still be overfull after an unlucky draw; that is a matter of a few target sizes.
    cell = ["range", "own", "part"]
    sums = cells.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    ahead = Window.orderBy("range", F.col("own").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    of_text = Window.partitionBy("range", "own")
    starts = settle(sums.select(
        *cell, F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("row_start"), "bytes"), "cells").select(
        F.col("range").alias("r"), F.col("own").alias("o"), F.col("part").alias("p"), "byte_start", "row_start",
        F.when(F.col("own").isNotNull(), F.min("byte_start").over(of_text)).alias("text_start"),
        F.when(F.col("own").isNotNull(), F.sum("bytes").over(of_text)).alias("text_bytes"))
    # One row per cell, and cells number about twice the ranges.
    placed = cells.join(F.broadcast(starts), (F.col("range") == F.col("r")) & F.col("own").eqNullSafe(F.col("o")) & (F.col("part") == F.col("p")))
    order = Window.partitionBy(*cell).orderBy("key", "id", "row")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*cell, "key")
    counted = placed.withColumn("at", F.col("byte_start") + F.coalesce(F.sum("size").over(running), F.lit(0))).withColumn(
        "n", F.col("row_start") + F.row_number().over(order) - 1).withColumn(
        "text_start", F.coalesce("text_start", F.min("at").over(same))).withColumn(
        "text_bytes", F.coalesce("text_bytes", F.sum("size").over(same)))
    together = F.col("text_bytes") <= F.lit(int(KEEP_TOGETHER * total / shards))
    middle = F.when(together, F.col("text_start") + F.expr("text_bytes div 2")).otherwise(F.col("at") + F.expr("size div 2"))
    shard = F.least(F.floor(middle * F.lit(shards) / F.lit(max(1, total))), F.lit(shards - 1)).cast("int")
    sharded = settle(counted.select("id", "size", "crc", "n", shard.alias("shard")), "shards")
    firsts = F.broadcast(sharded.groupBy("shard").agg(F.min("n").alias("first")))
    return sharded.join(firsts, "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("n") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
