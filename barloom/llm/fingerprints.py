"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words (A-Z lower-cased) weighted by how often they
occur. For sample ``k`` each term draws r and c from Gamma(2, 1) and b from
[0, 1), all from a hash of (term, k); with t = floor(ln(weight) / r + b) its
value is ln c - r * (t - b + 1), and the term of the least value, with its t, is
the sample. Two texts agree in a sample with the probability of their generalised
Jaccard similarity: sum of the least weights over sum of the greatest.

The order of documents, needed for edits that take from the next document, is
found in cells of the id range, and each cell gets a copy of the next cell's first
document, so no task sees more than a cell. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, settle, text_of

SAMPLES = 32
ROWS_PER_CELL = 4_000
MOST_CELLS = 100_000

_HALF = 1 << 32


def _uniform(h: Column, high: bool) -> Column:
    """One half of a 64-bit hash as a number inside (0, 1)."""
    half = F.shiftrightunsigned(h, 32) if high else h.bitwiseAND(F.lit(_HALF - 1))
    return (half.cast("double") + 0.5) / float(_HALF)


def terms(text: Column) -> Column:
    """Sorted hashes of all words."""
    # In a text of ASCII alone lower() does the same, by bytes.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    words = F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")
    # sort_array compares longs themselves; array_sort would evaluate a comparator for each pair.
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _weighted(hashes: Column) -> Column:
    """Runs of a sorted array: (term, weight)."""
    n = F.size(hashes)
    firsts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(hashes, i) != F.element_at(hashes, F.greatest(i - 1, F.lit(1)))))
    return firsts


def _sample(k: int) -> Column:
    """Sample ``k`` of a row (term, log_weight): its value in the upper half of a long, (term, t) hashed in the lower."""
    term = F.col("term")
    first, second, third = (F.xxhash64(term, F.lit(3 * k + i)) for i in range(3))
    r = -F.log(_uniform(first, True) * _uniform(first, False))
    c = -F.log(_uniform(second, True) * _uniform(second, False))
    b = _uniform(third, True)
    t = F.floor(F.col("log_weight") / r + b)
    value = F.log(c) - r * (t.cast("double") - b + 1.0)
    # 24 fractional bits; values lie far inside -64..64.
    place = F.least(F.greatest((value + 64.0) * float(1 << 24), F.lit(0.0)), F.lit(float((1 << 31) - 1))).cast("long")
    return F.shiftleft(place, 32).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(_HALF - 1)))


def signatures(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """``fingerprint`` (an array of ints) per ``keys`` of rows with an array column ``hashes`` of sorted term hashes."""
    counted = rows.select(*keys, "hashes", _weighted(F.col("hashes")).alias("firsts"))
    runs = counted.select(*keys, "hashes", F.explode(F.arrays_zip(
        F.col("firsts").alias("at"), F.concat(F.expr("slice(firsts, 2, size(firsts))"), F.array(F.size("hashes") + 1)).alias("next"))).alias("x"))
    weighted = runs.select(*keys, F.element_at("hashes", F.col("x.at")).alias("term"),
                           F.log((F.col("x.next") - F.col("x.at")).cast("double")).alias("log_weight"))
    least = weighted.groupBy(*keys).agg(*[F.min(_sample(k)).alias(f"m{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.col(f"m{k}").bitwiseAND(F.lit(_HALF - 1)) for k in range(samples)]).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def _in_order(docs: DataFrame, id_col: str, text_col: str, rows_per_cell: int) -> DataFrame:
    """Rows with their place (cell, pos) in descending id order, and the next row's text and place.

    Null ids come last, rows of one id by a hash of their text. The last row is followed by the first.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.xxhash64(text_of(text_col)).alias("h"))
    low, high, n, known = rows.agg(F.min("id"), F.max("id"), F.count(F.lit(1)), F.count("id")).first()
    cells = min(MOST_CELLS, max(1, n // rows_per_cell))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // cells))
    # Null ids are split by the same hash that orders them.
    cell = F.when(F.col("id").isNotNull(), F.expr(f"(id - {low or 0}) div {width}")).otherwise(
        F.floor((F.shiftright("h", 40) + (1 << 23)) * cells / (1 << 24)) - cells - 1)
    celled = rows.withColumn("cell", cell)
    # At most 2 * MOST_CELLS rows.
    firsts = celled.groupBy("cell").agg(F.max(F.struct("id", "h")).alias("first"))
    ring = Window.orderBy(F.desc("cell"))
    everything = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = settle(firsts.select(
        "first", "cell", F.coalesce(F.lag("cell").over(ring), F.last("cell").over(everything)).alias("host")), "cells")
    hosted = celled.join(F.broadcast(guests.select("cell", "host", F.col("first.id").alias("gid"), F.col("first.h").alias("gh"))), "cell").where(
        F.col("id").eqNullSafe(F.col("gid")) & (F.col("h") == F.col("gh")))
    both = celled.select("id", "text", "h", "cell", F.lit(0).alias("guest"), F.col("cell").alias("home")).union(
        hosted.select("id", "text", "h", F.col("host").alias("cell"), F.lit(1).alias("guest"), F.col("cell").alias("home")))
    order = Window.partitionBy("cell").orderBy("guest", F.desc_nulls_last("id"), F.desc("h"))
    return both.withColumn("pos", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order)).withColumn(
        "next_guest", F.lead("guest").over(order)).withColumn("next_home", F.lead("home").over(order)).where("guest = 0").select(
        "id", "text", "next_text", "cell", F.col("pos").cast("long").alias("pos"), F.col("next_home").alias("next_cell"),
        F.when(F.col("next_guest") == 1, F.lit(1)).otherwise(F.col("pos") + 1).cast("long").alias("next_pos"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                 rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document in descending id order; after
    the last comes the first, and a single document follows itself. Null text
    counts as empty; texts without words have equal fingerprints. Null ids come
    after all others and rows of one id are ordered by a hash of their text.
    An empty table gives an empty result.
    """
    placed = _in_order(docs, id_col, text_col, rows_per_cell)
    n = F.length("text")
    half = F.expr("length(text) div 2")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = placed.select("id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "cell", "pos", "next_cell", "next_pos")
    keys = ["cell", "pos", "kind", "id", "n_chars", "sha", "next_cell", "next_pos"]
    texts = made.select("cell", "pos", "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "next_cell", "next_pos",
                        F.explode(F.array(F.struct(F.lit(0).alias("kind"), terms(F.col("text")).alias("hashes")),
                                          F.struct(F.lit(1).alias("kind"), terms(F.col("edited")).alias("hashes")))).alias("v"))
    # A text without words has one fixed term. Put in here, where the hashes are made already: an expression with a lambda that
    # is named twice in one step is evaluated twice.
    hashes = F.when(F.size("v.hashes") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.col("v.hashes")).alias("hashes")
    # Rows of a cell are together already, so grouping by document needs no further shuffle.
    signed = settle(signatures(texts.select(*[k for k in keys if k != "kind"], "v.kind", hashes), keys, samples), "signatures")
    own = signed.where("kind = 0").select("cell", "pos", "id", "n_chars", "sha", "next_cell", "next_pos", "fingerprint")
    other = signed.where("kind = 1").select("cell", "pos", F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("cell").alias("next_cell"), F.col("pos").alias("next_pos"), F.col("fingerprint").alias("next_fingerprint"))
    full = own.join(other, ["cell", "pos"]).join(after, ["next_cell", "next_pos"])
    return full.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
