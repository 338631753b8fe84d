"""Exact duplicates by a tree merge of sorted digest runs.

Each row is reduced to a digest entry: a 64-bit sort digest, the SHA-256 that
verifies it, an identifier and a count. Rows are dealt to runs by a hash of the
row, so copies of one text spread over all runs however many there are. In each
of the binomial rounds, ``FAN_IN`` runs that agree in all but one digit of their
number exchange their entries: an entry goes to the run whose digit equals the
next digit of its digest. The runs that meet are sorted and merged; entries of
equal digest and equal SHA-256 become one that keeps the preferred identifier
and the summed count. After the last round a run holds one digest range, and
each text exactly once. A text with a third of all rows arrives in a round as at
most one entry per sending run, because every round merges before it sends.

The winner then travels the same way back: entries of the first round look it up
by digest, and rows look it up by (run, digest), a key that a hot text shares
with few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, keep_rows, settle, text_of, text_tag

FAN_IN_BITS = 4
ROWS_PER_RUN = 200_000


def _digit(digest: Column, level: int) -> Column:
    """Digit ``level`` of the digest, counted from its highest bits."""
    moved = F.shiftrightunsigned(digest, 64 - FAN_IN_BITS * (level + 1))
    return moved.bitwiseAND(F.lit((1 << FAN_IN_BITS) - 1)).cast("int")


def _merge(sent: DataFrame) -> DataFrame:
    """Bring each run together, sort it by digest, and make one entry of those that are verified equal."""
    run = sent.repartition("run").sortWithinPartitions("run", "digest", "sha")
    return run.groupBy("run", "digest", "sha").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def _exchange(runs: DataFrame, level: int, levels: int) -> DataFrame:
    """One round: digit ``level`` of the run number becomes that digit of the digest, then runs merge."""
    shift = FAN_IN_BITS * (levels - 1 - level)
    others = F.lit(~(((1 << FAN_IN_BITS) - 1) << shift))
    target = F.col("run").bitwiseAND(others).bitwiseOR(F.shiftleft(_digit(F.col("digest"), level), shift))
    return _merge(runs.withColumn("run", target))


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One settled digest entry per row, with a row number that tells repeated rows apart."""
    plain = docs.select(F.col(id_col).alias("id"), text_tag(text_col).alias("tag"),
                        ascii_lower(text_of(text_col)).cast("binary").alias("bytes"))
    return settle(plain.select(
        "id", "tag", F.xxhash64("bytes").alias("digest"), F.sha2("bytes", 256).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "digests")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                     rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, text_tag.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. The row with the ``largest`` (or ``smallest``) id of a group stays;
    a null id loses against every other. Of rows that repeat an id with an equal
    text, one is marked kept. Other columns of ``docs`` are not read, so their
    names cannot clash. An empty table gives an empty result. ``rows_per_run``
    sets how many runs, and so how many rounds, there are; the result is the
    same for any.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is 'largest' or 'smallest'")
    rank = F.col("id") if keep == "largest" else -F.col("id")
    dealt = entries(docs, id_col, text_col)
    levels = 1
    while dealt.count() > rows_per_run << (FAN_IN_BITS * levels):
        levels += 1
    rows = dealt.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(1 << FAN_IN_BITS * levels)).cast("int"))
    # A struct orders null first, so a null id loses; the row number settles repeated ids.
    first = settle(_merge(rows.select(
        "run", "digest", "sha", F.struct(rank.alias("rank"), "id", "row").alias("best"), F.lit(1).alias("n"))), "runs")
    merged = first
    for level in range(levels):
        merged = _exchange(merged, level, levels)
    winners = merged.select("digest", "sha", F.col("best").alias("winner"), F.col("n").alias("group_size"))
    by_run = first.select("run", "digest", "sha").join(winners, ["digest", "sha"])
    found = rows.join(by_run, ["run", "digest", "sha"])
    return found.select(
        F.col("id").alias(id_col), F.col("winner.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("tag").alias("text_tag"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and nothing else."""
    stays = exact_duplicates(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("id"), F.col("text_tag").alias("tag"))
    return keep_rows(docs, stays, id_col, text_col)
