"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in hashed order, fill blocks of ``block_size`` characters.
Weights are whole quotas that add up to ``resolution``: in every round of that
many slots a source gets its quota of blocks. Block ``j`` of ``c`` in a round of
``L`` slots is released at ``floor(j * L / c)`` and due at ``ceil((j + 1) * L / c)``;
earliest deadline first among the released blocks then keeps every source less
than one block from its fluid share at every slot. A source that runs out leaves
the round, and the others go on in the same proportions; the round in which it
ends is scheduled for the blocks it still has. So a schedule is needed only per
stretch of like rounds, at most ``2 * sources + 1`` of them, however many rows
there are.

Numbering the rows of a source is split by hash into buckets of bounded size,
and the bucket totals give each bucket's start, so a source with a third of all
rows does not meet in one task. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import as_row, settle, text_of

OTHER = "other"
ROWS_PER_BUCKET = 20_000


def quotas(weights: Mapping[str, float], other: float, resolution: int) -> dict[str, int]:
    """Whole quotas per source (largest remainders, at least one each); they add up to ``resolution`` or a little more."""
    shares = {**weights, OTHER: other}
    if OTHER in weights:
        raise ValueError(f"'{OTHER}' names the sources without a weight of their own; give it as `other`")
    if any(not w > 0 for w in shares.values()):
        raise ValueError("weights must be above zero")
    exact = {s: resolution * w / sum(shares.values()) for s, w in shares.items()}
    whole = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[:max(0, resolution - sum(whole.values()))]:
        whole[s] += 1
    return whole


def _round_plan() -> Column:
    """Earliest deadline first over one round: jobs ``c`` by source index, ``L`` slots; each pick is (source, number, release, due)."""
    def step(state: Column, slot: Column) -> Column:
        def window(i):
            done = F.element_at(state["done"], i + 1)
            count = F.element_at(F.col("c"), i + 1)
            rate = F.greatest(count, F.lit(1))
            return F.struct(
                F.ceil((done + 1) * F.col("L") / rate).alias("due"), i.alias("source"), done.alias("number"),
                F.floor(done * F.col("L") / rate).alias("release"), count.alias("count"))

        open_jobs = F.filter(F.transform(F.sequence(F.lit(0), F.size("c") - 1), window),
                             lambda w: (w["number"] < w["count"]) & (w["release"] <= slot))
        pick = F.array_min(open_jobs)
        return F.struct(
            F.transform(state["done"], lambda d, i: F.when(i == pick["source"], d + 1).otherwise(d)).alias("done"),
            F.concat(state["picks"], F.array(pick)).alias("picks"))

    empty = "array<struct<due:bigint,source:int,number:bigint,release:bigint,count:bigint>>"
    start = F.struct(F.transform("c", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast(empty).alias("picks"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("L") - 1), start, step)["picks"]


def schedule(totals: DataFrame, shares: Mapping[str, int]) -> DataFrame:
    """The slots of every stretch of like rounds.

    ``totals`` has ``mix_source`` and ``blocks``. The result has the stretch
    (``first_round``, ``next_round``, its ``base`` slot and round length ``L``)
    and for each block of a round ``mix_source``, ``number``, ``pos``,
    ``release`` and ``due``. Its size is bounded by the number of weights and
    the resolution.
    """
    spark = totals.sparkSession
    listed = ", ".join(f"({i}, :s{i}, {n})" for i, n in enumerate(shares.values()))
    names = spark.sql(f"SELECT * FROM VALUES {listed} AS t(i, mix_source, quota)",
                      {f"s{i}": s for i, s in enumerate(shares)})
    each = names.join(F.broadcast(totals), "mix_source", "left").select(
        "i", "mix_source", F.col("quota").cast("long").alias("quota"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("i", "mix_source", "quota", "blocks"))).alias("s"))
    zero = F.lit(0).cast("long")
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(
        zero, F.floor(x["blocks"] / x["quota"]), F.ceil(x["blocks"] / x["quota"]))))))
    stretches = one.select("s", edges.alias("e")).select("s", F.explode(F.arrays_zip(
        F.expr("slice(e, 1, size(e) - 1)").alias("first_round"), F.expr("slice(e, 2, size(e))").alias("next_round"))).alias("z"))
    counts = stretches.select("s", "z.first_round", "z.next_round").withColumn("c", F.transform("s", lambda x: F.greatest(
        zero, F.least(x["quota"], x["blocks"] - F.col("first_round") * x["quota"]))))
    sized = counts.withColumn("L", F.aggregate("c", zero, lambda a, x: a + x)).withColumn("base", F.aggregate(
        "s", zero, lambda a, x: a + F.least(x["blocks"], F.col("first_round") * x["quota"])))
    picked = sized.where("L > 0").withColumn("picks", _round_plan())
    return picked.select("s", "first_round", "next_round", "base", "L", F.posexplode("picks").alias("pos", "p")).select(
        F.expr("s[p.source].mix_source").alias("mix_source"), F.expr("s[p.source].quota").alias("quota"),
        "first_round", "next_round", "base", "L", "pos", F.col("p.number").alias("number"),
        F.col("p.release").alias("release"), F.col("p.due").alias("due"))


def interleave(docs: DataFrame, weights: Mapping[str, float], other: float, block_size: int, resolution: int = 100,
               id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
               carry: Sequence[str] | None = None, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every row with its place in the mixed order.

    The result has ``row`` (a struct of the ``carry`` columns, all by default,
    so that no name can clash), ``mix_source``, ``size``, ``block`` (of its
    source), ``slot`` (of the mix), ``release`` and ``due`` (the block's
    window, ``release <= slot < due``) and ``at`` (offset of the row in the
    block); rows in order of (slot, at) are the mix. A row belongs to the block
    in which it starts; a row longer than a block leaves the slots that it
    covers to itself. Sources without a weight, null among them, share the
    weight ``other``. Size is the number of characters, at least one. Repeated
    rows each get a place of their own. An empty table gives an empty result.
    """
    if block_size < 1 or resolution < 1:
        raise ValueError("block_size and resolution must be positive")
    shares = quotas(weights, other, resolution)
    text = text_of(text_col)
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)).otherwise(F.lit(OTHER))
    keyed = docs.select(
        as_row(docs, carry).alias("row"), named.alias("mix_source"), F.greatest(F.length(text), F.lit(1)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text).alias("h"), F.xxhash64(text).alias("tie"))
    buckets = max(1, docs.count() // rows_per_bucket)
    dealt = keyed.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    sums = settle(dealt.groupBy("mix_source", "bucket").agg(F.sum("size").alias("total")), "buckets")
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("mix_source", "bucket", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    totals = sums.groupBy("mix_source").agg(F.ceil(F.sum("total") / block_size).alias("blocks"))
    within = Window.partitionBy("mix_source", "bucket").orderBy("h", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, ["mix_source", "bucket"]).withColumn(
        "start", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    quota_of = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])
    blocked = placed.select(
        "row", "mix_source", "size", F.expr(f"start div {int(block_size)}").alias("block"),
        F.expr(f"start % {int(block_size)}").alias("at"), F.element_at(quota_of, F.col("mix_source")).cast("long").alias("per_round")
    ).withColumn("round", F.expr("block div per_round")).withColumn("number", F.expr("block % per_round"))
    # At most (2 * weights + 1) * (resolution + weights) rows, whatever the data.
    plan = F.broadcast(schedule(totals, shares).drop("quota"))
    found = blocked.join(plan, ["mix_source", "number"]).where("round >= first_round AND round < next_round")
    offset = F.expr("base + (round - first_round) * L")
    return found.select("row", "mix_source", "size", "block", (offset + F.col("pos")).alias("slot"),
                        (offset + F.col("release")).alias("release"), (offset + F.col("due")).alias("due"), "at")


def place(docs: DataFrame) -> Column:
    """The place of each row of a written mix, read back: a struct that sorts as the mix does.

    It has the numbers of the part file (``part``, ``piece``) and the row's number in it (``row``), so it is right however
    the reader packs the files. For a frame that was not read from files it is the place in the frame's own order; in a
    file that Spark did not name, ``part`` and ``piece`` are null.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta["row_index"])
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return F.struct(F.shiftright(at, 33).cast("int").alias("part"), F.lit(0).alias("piece"), at.bitwiseAND(F.lit(2**33 - 1)).alias("row"))

    def number(regex: str) -> Column:
        return F.nullif(F.regexp_extract(meta["file_name"], regex, 1), F.lit("")).cast("int")

    return F.struct(number("^part-([0-9]+)-").alias("part"), number(r"^part-.*-c([0-9]+)\.").alias("piece"), meta["row_index"].alias("row"))


def mixed(docs: DataFrame, weights: Mapping[str, float], other: float, block_size: int, resolution: int = 100, **names) -> DataFrame:
    """The rows of ``docs`` in mixed order: sorted by place across and within partitions."""
    placed = interleave(docs, weights, other, block_size, resolution, **names)
    return placed.repartitionByRange("slot", "at").sortWithinPartitions("slot", "at").select("row.*")
