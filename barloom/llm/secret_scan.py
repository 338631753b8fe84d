"""Secret scan with corpus-wide ownership frequency.

Candidates are credential assignments, access keys, long hexadecimal strings and
other long mixed tokens. The hash of each candidate's value is counted over the
whole corpus by distinct repositories and distinct owners. A value that several
owners have is a copied example; a value of one owner that looks random is
probably live. Assignments, access keys and hexadecimal strings are always
reported; a mixed token only if it is owner-specific and looks live.

DataFrame functions only. Counts are combined before each shuffle, and the
verdict on a value reaches its occurrences by way of (value, part), so an example
in a third of all rows does not meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import settle, text_of
from barloom.llm.spans import SPAN, Pattern, ordered, overlaps_ordered, with_matches, written

# The kinds and their expressions. Possessive quantifiers never give back characters, which changes no
# match here and keeps very long runs linear.
PATTERNS = (
    Pattern("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", 1, "[:=]"),
    Pattern("access", r"AKIA[A-Z0-9]{16,}+", hint="AKIA"),
    Pattern("hex", r"[0-9a-f]{24,}+"),
    Pattern("mixed", r"(?:\G|(?<![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"),
)
BASE = ("assign", "access", "hex")
VALUE_PARTS = 256
EXAMPLE_OWNERS = 2


def _looks_live(value: Column) -> Column:
    """Letters of both cases and digits, and no character that makes up a third of the value."""
    counts = F.transform(F.array_distinct(F.split(value, "")), lambda c: F.length(value) - F.length(F.replace(value, c, F.lit(""))))
    return (F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]"))
            & (F.array_max(counts) * 3 <= F.length(value)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repository_cols: tuple[str, ...] = ("source", "lang"), example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, findings.

    ``findings`` lists every reported span with its value's hash, ``repositories``,
    ``owners`` and ``verdict``: ``example`` from ``example_owners`` distinct owners
    on, else ``specific``, or ``live`` if it also looks random. Null text counts
    as empty and has no spans; a null owner or repository is one of its own.
    Repeated rows and ids are scanned row by row. An empty table gives an empty
    result. Only the named columns are read.
    """
    unknown = F.lit("~")
    rows = docs.select(
        F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.coalesce(F.col(owner_col).cast("string"), unknown).alias("owner"),
        F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), unknown) for c in repository_cols]).alias("repository"))
    found = with_matches(rows, PATTERNS)
    kinds = found.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= 6))
    # Spans of one kind do not overlap, so each kind is searched on its own.
    more = F.filter("mixed", lambda s: ~reduce(Column.__or__, [overlaps_ordered(F.col(k), s["start"], s["end"]) for k in BASE]))
    scanned = settle(kinds.select(
        "id", "owner", "repository", F.monotonically_increasing_id().alias("row"), ordered(*[F.col(k) for k in BASE]).alias("base"),
        more.alias("more")), "scanned")
    hit = scanned.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select(
        "row", "owner", "repository", "s", F.sha2("s.value", 256).alias("value_hash"))
    # Distinct (value, owner, repository), then repositories per owner, then both per value.
    places = hit.select("value_hash", "owner", "repository").distinct()
    owners = places.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    spread = owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    parted = hit.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(VALUE_PARTS)))
    known = parted.select("value_hash", "part").distinct().join(spread, "value_hash")
    judged = parted.join(known, ["value_hash", "part"]).withColumn("verdict", F.when(
        F.col("owners") >= example_owners, "example").when(_looks_live(F.col("s.value")), "live").otherwise("specific"))
    reported = judged.where((F.col("s.kind") != "mixed") | (F.col("verdict") == "live"))
    findings = reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "s.start", "s.rank", "s.end", "s.kind", "value_hash", "owners", "repositories", "verdict"))).alias("findings"))
    none = F.array().cast(findings.schema["findings"].dataType)
    full = scanned.join(findings, "row", "left").withColumn("findings", F.coalesce("findings", none))

    def count(array: str, field: str, value: str) -> Column:
        return F.size(F.filter(array, lambda s: s[field] == value)).cast("long")

    return full.select(
        F.col("id").alias(id_col), *[count("base", "kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("findings")).alias("spans"),
        count("findings", "verdict", "live").alias("n_live"), count("findings", "verdict", "example").alias("n_example"), "findings")
