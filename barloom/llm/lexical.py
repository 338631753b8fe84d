"""Ranked lexical search turned round: the items are indexed, the documents stream past.

An inverted index over the items' terms goes to every executor; items beyond its
size bound are taken in several blocks. One pass over the texts keeps, for each
document, its length and its counts of the index's terms. Corpus statistics come
from that table, and a second pass sends each document's counts through the
index's postings. Each task keeps a bounded heap per item, and the heaps are
merged. Postings of documents are never written or shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import quote, settle
from barloom.session import counted_bytes

# Text of the items whose index is broadcast at once.
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
# Cells of the score table that a task holds at once, and postings that it expands at once.
CELLS = 1 << 21
EXACT = float(1 << 53)

# In UTF-8 every byte of a character beyond ASCII is at least 0x80; bytes.lower() changes A-Z only.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, by pieces of about ``PIECE_BYTES``."""
    data, at = text.lower(), 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield _TERM.findall(data, at, end)
        at = end


@dataclass
class Index:
    """The terms of a block of items, and for each term the items that hold it and how often."""

    ids: pa.Array
    numbers: dict[bytes, int]
    ends: np.ndarray
    items: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(ids: pa.Array, texts: list[bytes]) -> Index:
        numbers: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for item, text in enumerate(texts):
            for terms in terms_of(text):
                for term in terms:
                    key = (numbers.setdefault(term, len(numbers)), item)
                    pairs[key] = pairs.get(key, 0) + 1
        table = np.array(sorted((*key, n) for key, n in pairs.items()), np.int64).reshape(-1, 3)
        ends = np.searchsorted(table[:, 0], np.arange(len(numbers) + 1))
        return Index(ids, numbers, ends, table[:, 1].copy(), table[:, 2].copy())


@dataclass
class Weighted:
    """What scoring needs: postings with weights times repeats, and the corpus's size."""

    ids: pa.Array
    ends: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    documents: int
    terms: int


def _counted(index):
    """(id, number of terms, index terms and their counts) of each document that has a term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value.numbers.get
        for batch in batches:
            rows, lengths, found, counts = [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                n, hits = 0, []
                for terms in terms_of(text.as_py() or b""):
                    n += len(terms)
                    hits += [i for i in map(known, terms) if i is not None]
                if n:
                    numbers, times = np.unique(np.array(hits, np.int32), return_counts=True)
                    rows.append(row)
                    lengths.append(n)
                    found.append(numbers)
                    counts.append(times)
            if not rows:
                continue
            ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int32())), pa.array(lengths, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts).astype(np.int64)))], names=["id", "n", "terms", "counts"])
    return run


class Heaps:
    """The best ``k`` (score, id) of every item; ties go to the smaller id, null after all others."""

    def __init__(self, items: int, k: int):
        self.k, self.size = k, 0
        self.floor = np.zeros(items, np.int64)
        self.floor_id = np.full(items, np.iinfo(np.int64).min)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.most = max(1 << 16, 4 * k * items)

    def offer(self, item: np.ndarray, score: np.ndarray, number: np.ndarray, unknown: np.ndarray) -> None:
        least = self.floor[item]
        keep = (score > least) | ((score == least) & ~unknown & (number < self.floor_id[item]))
        self.held.append((item[keep], score[keep], number[keep], unknown[keep]))
        self.size += int(keep.sum())
        if self.size > self.most:
            self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            empty = np.empty(0, np.int64)
            return empty, empty, empty, empty.astype(bool)
        item, score, number, unknown = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((number, unknown, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order, item, rank = order[rank < self.k], item[rank < self.k], rank[rank < self.k]
        self.held = [(item, score[order], number[order], unknown[order])]
        self.size = len(item)
        last = rank == self.k - 1
        self.floor[item[last]] = score[order][last]
        self.floor_id[item[last]] = np.where(unknown[order][last], np.iinfo(np.int64).max, number[order][last])
        return self.held[0]


def _scores(index: Weighted, n: np.ndarray, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, items) scores; all of it whole numbers."""
    if int(n.max()) * 25 * index.documents < 1 << 63:
        m = 75 + 25 * n * index.documents // index.terms
    else:
        m = np.array([75 + 25 * int(x) * index.documents // index.terms for x in n], np.int64)
    doc = np.repeat(np.arange(len(n)), np.diff(ends))
    part = 1_000_000_000 * counts // (1000 * counts + 12 * m[doc])
    low, length = index.ends[terms], index.ends[terms + 1] - index.ends[terms]
    at = np.repeat(low - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
    cell = np.repeat(doc * len(index.ids), length) + index.items[at]
    value = index.weights[at] * np.repeat(part, length)
    size = len(n) * len(index.ids)
    # Nothing is negative, so sums below 2^53 are exact in doubles.
    total = np.bincount(cell, value, minlength=size)
    if total.max(initial=0) < EXACT:
        return total.astype(np.int64).reshape(len(n), -1)
    exact = np.zeros(size, np.int64)
    np.add.at(exact, cell, value)
    return exact.reshape(len(n), -1)


def _ranked(index, k: int, schema: pa.Schema):
    """Per task, the best ``k`` documents of each item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Weighted = index.value
        heaps = Heaps(len(known.ids), k)
        reach = np.diff(known.ends)
        for batch in batches:
            number, unknown = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            n, lists = batch.column(1).to_numpy(), batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            terms, counts = lists.values.to_numpy(), batch.column(3).values.to_numpy()
            cost = np.concatenate(([0], np.cumsum(reach[terms[ends[0]:ends[-1]]])))[ends - ends[0]]
            low = 0
            while low < len(n):
                high = min(int(np.searchsorted(cost, cost[low] + CELLS, side="right")) - 1, low + CELLS // max(1, len(known.ids)))
                high = max(high, low + 1)
                scores = _scores(known, n[low:high], terms[ends[low]:ends[high]], counts[ends[low]:ends[high]], ends[low:high + 1] - ends[low])
                row, item = np.nonzero((scores > 0) & (scores >= heaps.floor))
                heaps.offer(item, scores[row, item], number[low + row], unknown[low + row])
                low = high
        item, score, number, unknown = heaps.best()
        yield pa.RecordBatch.from_arrays([
            pa.array(item, pa.int64()), known.ids.take(pa.array(item)), pa.array(number, pa.int64(), mask=unknown), pa.array(score, pa.int64())], schema=schema)
    return run


def _ranking(docs: DataFrame, ids: pa.Array, texts: list[bytes], item_type: T.DataType, k: int) -> DataFrame:
    share = docs.sparkSession.sparkContext.broadcast
    index = Index.of(ids, texts)
    counted = settle(docs.mapInArrow(_counted(share(index)), "id long, n long, terms array<int>, counts array<long>"), "term-counts")
    size = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    # At most one row per term of the index.
    df = np.zeros(len(index.numbers), np.int64)
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * size["documents"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    weighted = Weighted(ids, index.ends, index.items, np.repeat(weight, np.diff(index.ends)) * index.times, size["documents"], size["terms"] or 1)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    heaps = counted.mapInArrow(_ranked(share(weighted), k, to_arrow_schema(schema)), schema)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` documents that score highest for each item: item_id, rank (from 1), doc_id, score.

    Terms are the runs of ASCII letters, digits and characters beyond ASCII in
    the whole text, A-Z lower-cased; null text has none. Only scores above 0 are
    listed. Equal scores go by ascending id (a whole number), null last; rows of
    ``docs`` that repeat are ranked each. Rows of ``items`` that repeat an id
    and a text are one item; rows that share an id only are ranked apart. An
    item without terms, or an empty table on either side, gives no rows. Only
    the named columns are read.

    ``block_bytes`` bounds the item text whose index is held at once; more items
    take more passes over the documents.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = settle(items.select(F.col(quote(item_col)).alias("item_id"), F.col(quote(item_text_col)).alias("text")).where(
        "text is not null").distinct(), "items")
    read = docs.select(F.col(quote(id_col)).cast("long").alias("id"), F.col(quote(text_col)).alias("text"))
    blocks = -(-counted_bytes(asked.select("text")) // block_bytes) or 1
    rankings = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        texts = [t.as_py() for t in part["text"].cast(pa.binary())]
        rankings.append(_ranking(read, part["item_id"].combine_chunks(), texts, asked.schema["item_id"].dataType, k))
    found = rankings[0]
    for more in rankings[1:]:
        found = found.union(more)
    return found
