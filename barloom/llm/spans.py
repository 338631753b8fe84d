"""Regular-expression matches with code-point positions, in DataFrame functions only.

``regexp_extract_all`` gives the matched strings and ``split`` the text between
them, both from the same leftmost, non-overlapping search; positions are their
running lengths, summed in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import quote

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Pattern:
    """A kind of span: its expression, the group that is its value, and a cheap test that any text with a match passes."""

    kind: str
    regex: str
    group: int = 0
    hint: str | None = None


def _maybe(text: Column, pattern: Pattern) -> Column:
    if pattern.hint is None:
        return F.lit(True)
    return F.contains(text, F.lit(pattern.hint)) if len(pattern.hint) == 1 else F.rlike(text, F.lit(pattern.hint))


def with_matches(df: DataFrame, patterns: Sequence[Pattern], text_col: str = "text") -> DataFrame:
    """Add one array of spans per kind, in column ``kind``; ``rank`` is the kind's place in ``patterns``."""
    text, none = F.col(quote(text_col)), F.array().cast("array<string>")
    for p in patterns:
        test = _maybe(text, p)
        df = df.withColumns({
            f"{p.kind}_all": F.when(test, F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))).otherwise(none),
            f"{p.kind}_part": F.when(test, F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group))).otherwise(none)
            if p.group else none})
    return df.select(
        *[c for c in df.columns if not any(c in (f"{p.kind}_all", f"{p.kind}_part") for p in patterns)],
        *[_positions(text, p, rank).alias(p.kind) for rank, p in enumerate(patterns)])


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, also inside a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(items: Column, size_of: Callable[[Column], Column], made: Callable[[Column, Column], Column]) -> Column:
    """``made(item, before)`` of each item, ``before`` being the sum of ``size_of`` over the items ahead of it.

    Sums are made in blocks: a fold that gathers an array copies it at each step,
    so one over n items costs their square. Blocks have the cube root of n items,
    which balances the copies within blocks and those of the blocks' sums.
    """
    def sums(sizes: Column, start: Column) -> Column:
        # Running sums, the last one is the sum of all.
        return F.aggregate(sizes, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def total(sizes: Column) -> Column:
        return F.aggregate(sizes, F.lit(0), lambda a, x: a + x)

    def in_blocks(kept: Column) -> Column:
        width = F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(kept).cast("double"))).cast("int"))
        firsts = F.sequence(F.lit(1), F.size(kept), width)
        blocks = F.transform(firsts, lambda i: F.slice(kept, i, width))
        return once(blocks, lambda every: F.flatten(F.zip_with(
            every, F.slice(sums(F.transform(every, lambda block: total(F.transform(block, size_of))), F.lit(0)), F.lit(1), F.size(every)),
            lambda block, before: once(sums(F.transform(block, size_of), before), lambda at: F.transform(
                block, lambda x, i: made(x, F.get(at, i)))))))

    return once(items, lambda kept: F.when(F.size(kept) > 0, in_blocks(kept)))


def _positions(text: Column, p: Pattern, rank: int) -> Column:
    whole = F.col(f"{p.kind}_all")
    value = F.col(f"{p.kind}_part") if p.group else whole
    between = F.slice(F.split(text, p.regex, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))

    def span(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x["whole"])).alias("end"), F.lit(p.kind).alias("kind"), x["value"].alias("value"))

    spans = running(zipped, lambda x: F.length(x["gap"]) + F.length(x["whole"]), span)
    return F.when(F.size(whole) == 0, F.array().cast(SPAN)).otherwise(spans.cast(SPAN))


def ordered(*arrays: Column) -> Column:
    """All spans by start, then by kind as listed."""
    return F.array_sort(F.concat(*arrays))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps_ordered(spans: Column, start: Column, end: Column) -> Column:
    """As ``overlaps`` for spans that are ordered and do not overlap each other, such as one kind's: a binary search.

    Of the spans that begin before ``end`` only the last can end after ``start``.
    """
    bits = F.sequence(F.floor(F.log2(F.size(spans).cast("double") + 1)).cast("int"), F.lit(0), F.lit(-1))
    ahead = F.aggregate(bits, F.lit(0), lambda n, bit: once(n + F.pow(F.lit(2.0), bit).cast("int"), lambda more: F.when(
        F.get(spans, more - 1)["start"] < end, more).otherwise(n)))
    return F.coalesce(F.get(spans, ahead - 1)["end"] > start, F.lit(False))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))
