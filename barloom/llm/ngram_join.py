"""N-gram Jaccard join with filters under several global token orders.

Two sets whose Jaccard similarity reaches ``percent`` share a token of their
prefixes, the first ``n - ceil(percent * n / 100) + 1`` tokens, under any order
of all tokens. Three orders are used:

1. a universe of tokens with small hashes first, rarest token first, then the
   other tokens by hash. Document counts are needed for the universe only, and a
   token that one set has is never written as a posting;
2. ascending hash;
3. descending hash.

Pairs that meet under the first order pass a size filter and a lower bound of the
symmetric difference from parity bits, 256 per set and 1024 for sets of
``WIDE_FROM`` shingles or more. Those that also meet under the other two orders
are verified; only for them whole sets are fetched.

Equal sets are one class from the start. Classes that share a frequent token are
not paired with each other at once: in rounds, until one links few (``STAR_SHARE`` of the first), each class
is held against the nearest of the classes drawn for its tokens, and classes found
linked get one label. Then every remaining pair of prefix partners with different
labels is held together, so no link that could join two components is left out,
while a large group of near copies never meets in all its pairs. There each posting
carries a few of its set's prefix tokens, the most frequent and the smallest, and
the wide parity bits; a pair that shares some of these tokens is made at one of
them only, not at every token of a common passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import keep_rows, scrambled, settle, text_tag
from barloom.llm.components import components
from barloom.llm.shingles import shingle_set, word_hashes

BLOOM_BITS = 1 << 25
STAR_ROUNDS = 8
STAR_SHARE = 0.05
SKETCH = ["s0", "s1", "s2", "s3"]
WIDE = 16
WIDE_FROM = 512
MARKS = 4
CLASS = ["k1", "k2", "n"]

_SALT = np.uint64(0x2545F4914F6CDD1D)


def prefix_size(n, percent: int):
    return n - (-(-percent * n // 100)) + 1


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _described(tokens: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Two sums that identify the set, its 256 parity bits, and 1024 of them where the set is large."""
    mixed = scrambled(tokens + _SALT)
    bits = np.bincount((mixed & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
    wide = _packed(bits) if len(tokens) >= WIDE_FROM else np.empty(0, np.int64)
    return (int(mixed.sum(dtype=np.uint64).view(np.int64)), int(scrambled(mixed).sum(dtype=np.uint64).view(np.int64)),
            _packed(bits.reshape(-1, 256).sum(axis=0) & 1), wide)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))


def _sets(width: int, percent: int, limit: int, schema: pa.Schema):
    """Per row: size, set identity, universe tokens, filled up to the prefix with the next hashes, and parity bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, kept, sketches, wides = [], [], [], [], [], []
            for _, words in word_hashes(batch.column(1)):
                tokens = shingle_set(words, width) >> np.uint64(1)
                n = len(tokens)
                a, b, sketch, wide = _described(tokens)
                need = prefix_size(n, percent) if n else 0
                sizes.append(n)
                first.append(a)
                second.append(b)
                sketches.append(sketch)
                wides.append(wide)
                kept.append(tokens[:max(need, int(np.searchsorted(tokens, np.uint64(limit))))].astype(np.int64))
            if not sizes:
                continue
            table = np.stack(sketches)
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                       _lists(kept), *[pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(SKETCH))], _lists(wides)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _positions(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = scrambled(values.astype(np.int64).view(np.uint64))
    return (mixed & np.uint64(bits - 1)).astype(np.int64), ((mixed >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


class Bloom:
    """A set of longs as at most ``BLOOM_BITS`` bits; it only saves shuffling rows that a join would drop anyway.

    Each batch of ``columns`` is turned into longs by ``key``.
    """

    def __init__(self, df: DataFrame, columns: list[str], key):
        self.bits = bits = min(BLOOM_BITS, 1 << max(10, (12 * df.count()).bit_length()))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(_positions(key(*batch.columns), bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at >> 6), pa.array(np.left_shift(np.int64(1), at & 63))], names=["word", "mask"])

        found = df.select(*columns).mapInArrow(words, "word long, mask long").groupBy("word").agg(
            F.bit_or("mask").alias("mask")).toArrow()
        self.words = np.zeros(bits >> 6, np.int64)
        self.words[found["word"].to_numpy()] = found["mask"].to_numpy()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        hit = np.ones(len(values), bool)
        for at in _positions(values, self.bits):
            hit &= ((self.words[at >> 6] >> (at & 63)) & 1).astype(bool)
        return hit


def _token_key(tokens: pa.Array) -> np.ndarray:
    return tokens.to_numpy()


def _row_key(first: pa.Array, ids: pa.Array) -> np.ndarray:
    """Of a class by its first sum, and of one of its rows by its id."""
    numbers = ids.cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64)
    return (first.to_numpy().view(np.uint64) ^ scrambled(numbers)).view(np.int64)


def _known(bloom):
    """Explode the tokens that are probably shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy()
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            hit = bloom.value(values)
            yield pa.RecordBatch.from_arrays([pa.array(owner[hit]), pa.array(values[hit])], names=["node", "token"])
    return run


def _whole_sets(width: int, bloom):
    """The whole sets of rows that probably stand for a wanted class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            sets = [shingle_set(words, width) >> np.uint64(1) for _, words in word_hashes(batch.column(1))]
            about = [_described(t)[:2] for t in sets]
            k1, k2 = (pa.array([x[k] for x in about], pa.int64()) for k in (0, 1))
            hit = np.flatnonzero(bloom.value(_row_key(k1, ids))) if sets else []
            if len(hit):
                at = pa.array(hit)
                yield pa.RecordBatch.from_arrays([
                    k1.take(at), k2.take(at), pa.array([len(sets[i]) for i in hit], pa.int64()),
                    pa.array([sets[i].astype(np.int64) for i in hit], pa.list_(pa.int64()))], names=[*CLASS, "tokens"])
    return run


def _verified(percent: int):
    """Labels of the pairs (lu, lv, and the two sets) whose exact similarity reaches ``percent``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for k in (2, 3):
                lists = batch.column(k)
                sides.append((lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()))
            linked = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = (values[ends[i]:ends[i + 1]] for values, ends in sides)
                both = _common(a, b)
                linked[i] = 100 * both >= percent * (len(a) + len(b) - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])
    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    merged = np.concatenate((a, b))
    merged.sort(kind="stable")
    return int(np.count_nonzero(merged[1:] == merged[:-1]))


def _apart(x: str, y: str, wide: bool = False) -> Column:
    """The least symmetric difference that the parity bits allow."""
    def differing(names: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in names), F.lit(0))

    # The wide bits are null where one of the sets is small.
    return F.coalesce(differing([f"wide.w{i}" for i in range(WIDE)]), differing(SKETCH)) if wide else differing(SKETCH)


def _close(x: str, y: str, percent: int, wide: bool = False) -> Column:
    """Size filter, and the bound that the parity bits give."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    # d differing tokens of n tokens in all: (n - d) / (n + d) >= p means d * (100 + p) <= n * (100 - p).
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & (_apart(x, y, wide) * (100 + percent) <= (nx + ny) * (100 - percent))


class _Links:
    """Verified links between classes, and the labels they give."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.labels: DataFrame | None = None

    def add(self, pairs: DataFrame) -> int:
        """Verify pairs (u, v, and their labels lu, lv) that meet under the first order; the number of new links.

        Labels come with the pairs and are not joined again: every stage costs the
        driver memory, however small.
        """
        size = F.size("tokens")
        prefix = (size - F.expr(f"({self.percent} * size(tokens) + 99) div 100") + 1).cast("int")
        ends = self.sets.select("node", F.slice("tokens", F.lit(1), prefix).alias("low"), F.slice("tokens", -prefix, prefix).alias("high"))
        x, y = ends.toDF("u", "xl", "xh"), ends.toDF("v", "yl", "yh")
        met = settle(pairs.select("u", "v", "lu", "lv").distinct().join(x, "u").join(y, "v").where(
            F.arrays_overlap("xl", "yl") & F.arrays_overlap("xh", "yh")).select("u", "v", "lu", "lv"), "pairs")
        a, b = self.sets.select("node", "tokens").toDF("u", "a"), self.sets.select("node", "tokens").toDF("v", "b")
        both = met.join(a, "u").join(b, "v").select("lu", "lv", "a", "b")
        found = settle(both.mapInArrow(_verified(self.percent), "u long, v long"), "links")
        new = found.count()
        if new:
            self._join(found, labelled=True)
        return new

    def _join(self, found: DataFrame, labelled: bool = False) -> None:
        """Labels after new links between nodes, or between their labels if ``labelled``; only labels that a new link touches are looked at again."""
        if self.labels is None:
            self.labels = settle(components(found), "labels")
            return
        # Merge joins, as in components: no table of each round passes through the driver.
        if not labelled:
            sides = self.labels.toDF("u", "lu").hint("merge"), self.labels.toDF("v", "lv").hint("merge")
            found = found.join(sides[0], "u", "left").join(sides[1], "v", "left").select(
                F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        merged = settle(components(found), "merged")
        moved = self.labels.join(merged.toDF("label", "to").hint("merge"), "label", "left").select(
            "node", F.coalesce("to", "label").alias("label"))
        self.labels = settle(moved.union(merged.join(self.labels.select("node").hint("merge"), "node", "left_anti").select(
            "node", "label")), "labels")

    def labelled(self, posts: DataFrame) -> DataFrame:
        """``posts`` with the label of each node, its own number while nothing is linked to it."""
        if self.labels is None:
            return posts.withColumn("label", F.col("node"))
        return posts.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _partners(links: _Links, posts: DataFrame) -> DataFrame:
    """Postings of tokens whose sets do not all have one label yet."""
    marked = links.labelled(posts)
    open_tokens = marked.groupBy("token").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("token")
    return settle(marked.join(open_tokens, "token", "left_semi"), "open")


def _stars(posts: DataFrame, turn: int, percent: int) -> DataFrame:
    """For each class, the nearest by parity bits of the classes of another label that its tokens chose, two per token."""
    def end(x: str) -> Column:
        return F.struct(F.col(f"{x}.node").alias("node"), F.col(f"{x}.label").alias("label"))

    who = F.struct(F.xxhash64("node", "token", F.lit(turn)).alias("dice"), "node", "label", "n", *SKETCH)
    chosen = posts.groupBy("token").agg(F.array(F.min(who), F.max(who)).alias("y")).select("token", F.explode("y").alias("y"))
    met = posts.alias("x").join(chosen, "token").where((F.col("x.label") != F.col("y.label")) & _close("x", "y", percent))
    nearest = met.groupBy(end("x").alias("x")).agg(F.min(F.struct(_apart("x", "y").alias("apart"), end("y").alias("y"))).alias("best"))
    pairs = nearest.select(F.least("x", "best.y").alias("u"), F.greatest("x", "best.y").alias("v"))
    return pairs.select("u.node", "v.node", "u.label", "v.label").toDF("u", "v", "lu", "lv")


def _remaining(posts: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """All pairs of different label that share a prefix token and may reach the threshold, at one of the marks they share if any."""
    full = posts.join(prefixes.select("node", "wide", "marks"), "node")
    x, y = full.alias("x"), full.alias("y")
    # A mark is a prefix token of both sets, and open because their labels differ.
    place = F.coalesce(F.array_min(F.array_intersect("x.marks", "y.marks")), F.col("x.token"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                 & (F.col("x.label") != F.col("y.label")) & _close("x", "y", percent, wide=True) & (place == F.col("x.token")))
    return met.select("x.node", "y.node", "x.label", "y.label").toDF("u", "v", "lu", "lv")


def similar_sets(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text",
                 star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, component_id, first_of_component, text_tag.

    Sets are the distinct ``width``-word shingles of the text with A-Z
    lower-cased; a shorter text is one shingle, and a text without words (or
    null) is an empty set that links with nothing. Two sets link when
    ``100 * common >= percent * union``. ``component_id`` is the smallest id
    reachable by links; where every reachable id is null it is null.
    ``class_id`` is equal for equal sets. ``first_of_component`` marks one row
    of each component, one with its smallest id, also where ids repeat; it is
    true for every empty set. Other columns are not read.
    """
    if not 0 < percent <= 100 or width < 1:
        raise ValueError("percent must be in 1..100 and width positive")
    share = spark_context(docs).broadcast
    limit = min((1 << 63) - 1, int(1.5 * (100 - percent) / 100 * (1 << 63)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_tag(text_col).alias("tag"))
    schema = T.StructType([
        T.StructField("id", texts.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in ("tag", "n", "k1", "k2")],
        T.StructField("tokens", T.ArrayType(T.LongType())), *[T.StructField(c, T.LongType()) for c in SKETCH],
        T.StructField("wide", T.ArrayType(T.LongType()))])
    sets = settle(texts.mapInArrow(_sets(width, percent, limit, to_arrow_schema(schema)), schema).withColumn(
        "row", F.monotonically_increasing_id()), "sets")
    # Equal sets have equal tokens and bits, so any row of a class stands for it; combined before the shuffle.
    classes = settle(sets.where("n > 0").groupBy(*CLASS).agg(
        F.first(F.struct("tokens", *SKETCH, "wide")).alias("c"),
        F.min(F.struct("row", "id")).alias("one"),
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("least")).select(
        F.col("one.row").alias("node"), F.col("one.id").alias("node_id"), *CLASS, "least", "c.*"), "classes")

    prefixes = _prefixes(classes, percent, limit, share)
    posts = prefixes.select("node", "n", *SKETCH, F.explode("prefix").alias("token"))
    partnered = posts.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    ends = posts.join(partnered, "token", "left_semi").select("node").distinct()
    wanted = settle(classes.select("node", "node_id", *CLASS).join(ends, "node", "left_semi"), "wanted")
    bloom = share(Bloom(wanted, ["k1", "node_id"], _row_key))
    whole = settle(texts.select("id", "text").mapInArrow(_whole_sets(width, bloom), "k1 long, k2 long, n long, tokens array<long>").join(
        wanted.select("node", *CLASS), CLASS).dropDuplicates(CLASS).select("node", "tokens"), "whole")

    links = _Links(whole, percent)
    first = 0
    for turn in range(star_rounds):
        # A token whose sets have one label stays closed.
        posts = _partners(links, posts)
        new = links.add(_stars(posts, turn, percent))
        posts, first = posts.drop("label"), first or new
        if new <= STAR_SHARE * first:
            break
    links.add(_remaining(_partners(links, posts), prefixes, percent))

    labelled = links.labelled(classes.select("node", *CLASS, "least"))
    groups = labelled.groupBy("label").agg(F.min("least").alias("group_least"))
    known = labelled.join(groups, "label").select(*CLASS, "least", "group_least")
    return sets.select("id", "row", "tag", *CLASS).join(known, CLASS, "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("class_id"),
        F.when(F.col("least").isNull(), F.col("id")).otherwise(F.col("group_least.id")).alias("component_id"),
        F.coalesce(F.col("group_least.row") == F.col("row"), F.lit(True)).alias("first_of_component"),
        F.col("tag").alias("text_tag"))


def spark_context(df: DataFrame):
    return df.sparkSession.sparkContext


def _prefixes(classes: DataFrame, percent: int, limit: int, share) -> DataFrame:
    """Per class (node, n, parity bits, prefix, marks): the first order's prefix without tokens that one class has."""
    in_universe = F.col("token") < F.lit(limit)
    shared = settle(classes.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    bloom = share(Bloom(shared, ["token"], _token_key))
    postings = classes.select("node", "tokens").mapInArrow(_known(bloom), "node long, token long").join(shared, "token")
    # Beyond the universe tokens follow in hash order, whatever their count. A list is bounded by its text.
    per_class = postings.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(
        (~in_universe).alias("outside"), F.when(in_universe, F.col("df")).otherwise(F.lit(0)).alias("df"), "token"))).alias("shared"))
    wide = F.when(F.size("wide") > 0, F.struct(*[F.element_at("wide", i + 1).alias(f"w{i}") for i in range(WIDE)]))
    sizes = classes.select("node", "n", *SKETCH, wide.alias("wide"), F.size(F.filter("tokens", lambda t: t < F.lit(limit))).alias("inside"))
    # The universe tokens of one class only come first; what the prefix still needs is taken from the shared ones.
    need = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    own = F.col("inside") - F.size(F.filter("shared", lambda s: ~s["outside"]))
    take = F.when(F.col("inside") >= need, F.greatest(need - own, F.lit(0))).otherwise(F.size("shared")).cast("int")
    # The last of the order are the most frequent, which sets with a passage in common have in common.
    marks = F.array_union(F.slice(F.reverse("prefix"), 1, MARKS), F.slice(F.array_sort("prefix"), 1, MARKS))
    held = ["node", "n", *SKETCH, "wide", "prefix"]
    return settle(per_class.join(sizes, "node").withColumn(
        "prefix", F.transform(F.slice("shared", F.lit(1), take), lambda s: s["token"])).select(*held, marks.alias("marks")), "prefixes")


def keep_one_of_each(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per component (the one with its smallest id), with their columns.

    Of rows that repeat an id with equal text one stays.
    """
    stays = similar_sets(docs, width, percent, id_col, text_col).where("first_of_component")
    return keep_rows(docs, stays.select(F.col(id_col).alias("id"), F.col("text_tag").alias("tag")), id_col, text_col)
