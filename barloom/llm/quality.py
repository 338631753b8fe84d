"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a document labelled good, one labelled bad) are fitted by
logistic loss on the differences of their features, without intercept: the model
is a score per document whose difference is the log odds of being preferred. A
quantile of the scores of all learned rows, the share of bad labels in them,
becomes the threshold, and scores are mapped to 0..1 so that the threshold lies
at ``CUT``.

The features are computed from whole texts by DataFrame functions. Learning uses
every labelled document but those whose CRC of the id is divisible by five: those
are held out. All pairs are used up to ``PAIRS``. Their number grows with the
square of the rows, so beyond that rows are dealt into groups that hold both
labels, and each row is held against all of the other label in its group: every
row takes part, in pairs that grow in proportion to the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import as_row, settle, text_of
from barloom.operators.stats import exact_quantiles

PAIRS = 100_000
PAIRS_A_ROW = 5
BUCKET_ROWS = 2_000
CUT = 0.3
HELD_OUT_EVERY = 5

FEATURES = ("log_words", "word_length", "symbol_share", "upper_share", "digit_share", "bar_share", "mark_share", "stop_share",
            "repeat_share", "new_share", "line_share", "same_line_share", "long_share", "short_share", "missing")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether an id is never learned from; a null id is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT_EVERY == 0


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def with_features(rows: DataFrame) -> DataFrame:
    """Add the features of column ``text`` (not null) to ``rows``; the text itself goes."""
    kept = [c for c in rows.columns if c != "text"]
    n = F.length("text")
    counted = rows.select(
        *kept, n.alias("chars"), F.split("text", r"\s+").alias("raw"), F.split("text", "\n").alias("lines"),
        *[F.regexp_count("text", F.lit(p)).alias(c) for c, p in (
            ("symbols", r"[^\p{L}\p{N}\s]"), ("upper", r"\p{Lu}"), ("digit", r"[0-9]"))],
        *[(n - F.length(F.replace(F.col("text"), F.lit(p), F.lit("")))).alias(c) for c, p in (("bars", "|"), ("marks", "!"), ("stops", "."))])
    words = counted.withColumn("words", F.filter("raw", lambda w: w != "")).drop("raw")
    again = F.zip_with(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))),
                       F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), lambda a, b: a == b)
    lengths = F.transform("words", F.length)
    sized = words.select(
        *kept, "chars", "symbols", "upper", "digit", "bars", "marks", "stops", F.size("words").alias("n_words"),
        F.size(F.array_distinct("words")).alias("new"), F.size(F.filter(again, lambda x: x)).alias("repeats"),
        F.size(F.filter(lengths, lambda x: x > 12)).alias("longs"), F.size(F.filter(lengths, lambda x: x <= 3)).alias("shorts"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("new_lines"))
    w, c = F.col("n_words"), F.col("chars")
    return sized.select(
        *kept, F.log1p(w.cast("double")).alias("log_words"), _share(c, w).alias("word_length_raw"), _share(F.col("symbols"), c).alias("symbol_share"),
        _share(F.col("upper"), c).alias("upper_share"), _share(F.col("digit"), c).alias("digit_share"),
        _share(F.col("bars"), w).alias("bar_share"), _share(F.col("marks"), w).alias("mark_share"), _share(F.col("stops"), w).alias("stop_share"),
        _share(F.col("repeats"), w).alias("repeat_share"),
        # Heaps-like: new words against the power of the length that prose follows.
        (F.col("new") / F.pow(F.greatest(w, F.lit(1)).cast("double"), F.lit(0.8))).alias("new_share"),
        _share(F.col("n_lines"), w).alias("line_share"), _share(F.col("n_lines") - F.col("new_lines"), F.col("n_lines")).alias("same_line_share"),
        _share(F.col("longs"), w).alias("long_share"), _share(F.col("shorts"), w).alias("short_share"),
        (w == 0).cast("double").alias("missing")).withColumn(
        "word_length", F.least(F.col("word_length_raw"), F.lit(40.0))).drop("word_length_raw")


@dataclass(frozen=True)
class Ranking:
    """Feature weights, the raw score at the threshold, and the unit in which scores around it are mapped."""

    weights: dict[str, float]
    threshold: float
    unit: float

    def raw(self) -> Column:
        return sum((F.col(name) * F.lit(w) for name, w in self.weights.items()), F.lit(0.0))

    def score(self) -> Column:
        """0 to 1, and ``CUT`` exactly at the threshold."""
        odds = (self.raw() - F.lit(self.threshold)) / F.lit(self.unit) + F.lit(math.log(CUT / (1 - CUT)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def dealt(rows: DataFrame, counts: dict[float, int], pairs: int = PAIRS) -> DataFrame:
    """``rows`` with ``bucket`` and ``slot``, the group in which a row meets those of the other label.

    ``counts`` has the rows of each label, both above zero. There is one group
    while all pairs are at most ``pairs``; beyond that, groups make that many or
    ``PAIRS_A_ROW`` per row. Rows are numbered within hashed parts of a label, and
    a part has more rows than its bucket has slots, so no group lacks a label.
    """
    every, least = counts[0.0] * counts[1.0], min(counts.values())
    buckets = max(1, least // BUCKET_ROWS) if every > pairs else 1
    slots = max(1, every // max(pairs, PAIRS_A_ROW * sum(counts.values())) // buckets)
    if slots == 1:
        return rows.withColumns({"bucket": F.pmod("dice", F.lit(buckets)), "slot": F.lit(0)})
    parts = F.when(F.col("label") == 1, max(1, counts[1.0] // buckets // BUCKET_ROWS)).otherwise(max(1, counts[0.0] // buckets // BUCKET_ROWS))
    placed = rows.withColumns({"bucket": F.pmod("dice", F.lit(buckets)), "part": F.pmod(F.xxhash64("id", F.lit(6)), parts)})
    number = F.row_number().over(W.partitionBy("label", "bucket", "part").orderBy("dice", "id", *FEATURES))
    return placed.withColumn("slot", number % slots).drop("part")


def fit(docs: DataFrame, labels: DataFrame, pairs: int = PAIRS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Ranking:
    """Learn from every labelled row that is not held out; without both labels every document scores the same, above the cut."""
    usable = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # Features meet labels, not texts: a shuffle moves a row's few numbers, at any size.
    learned = settle(with_features(texts).join(usable.hint("merge"), "id").withColumn("dice", F.xxhash64("id", F.lit(5))), "learned")
    counts = {r["label"]: r["count"] for r in learned.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Ranking({name: 0.0 for name in FEATURES}, -1.0, 1.0)
    grouped = dealt(learned, counts, pairs)
    good, bad = grouped.where("label = 1").alias("g"), grouped.where("label = 0").alias("b")
    turned = F.when(F.pmod(F.xxhash64("g.id", "b.id"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    differences = good.join(bad, (F.col("g.bucket") == F.col("b.bucket")) & (F.col("g.slot") == F.col("b.slot"))).select(
        *[((F.col(f"g.{f}") - F.col(f"b.{f}")) * turned).alias(f) for f in FEATURES], ((turned + 1) / 2).alias("label"))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(settle(differences, "differences"))
    model = LogisticRegression(fitIntercept=False, regParam=1e-4, maxIter=100).fit(vectors)
    ranking = Ranking(dict(zip(FEATURES, (float(x) for x in model.coefficients))), 0.0, 1.0)
    total = sum(counts.values())
    bad_share = counts[0.0] / total
    # Of n rows, a share p is reached at the row of rank ceil(p * n).
    places = {name: (max(1, math.ceil(p * total)) - 1) / (total - 1) for name, p in (
        ("low", bad_share * 0.98), ("high", min(1.0, bad_share * 1.02)), ("near", 0.5))}
    at = exact_quantiles(learned.select(F.lit(0).alias("all"), ranking.raw().alias("raw")), "all", "raw", places).first()
    threshold = (at["low"] + at["high"]) / 2
    return Ranking(ranking.weights, threshold, max(1e-9, abs(at["near"] - threshold) / 4))


def classify(docs: DataFrame, ranking: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null text counts as empty and is scored like any text. Equal texts score
    equally. Labels, ids and other columns are no inputs of a score. Repeated
    rows are scored row by row; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    scored = with_features(rows).select("id", "held_out", ranking.score().alias("score"))
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, ranking: Ranking, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``CUT``, with their columns; one pass, no shuffle."""
    rows = docs.select(as_row(docs).alias("row"), text_of(text_col).alias("text"))
    return with_features(rows).where(ranking.score() >= CUT).select("row.*")
