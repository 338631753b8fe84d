"""Exact top-k search and ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from barloom.llm import kd_search, lexical

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("cell", T.StringType()), T.StructField("row", T.StringType())])
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("terms", T.StringType()), T.StructField("n", T.StringType())])


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", "r") for i, v in rows], VECTORS)


def _nearest(rows, asked, k, width):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if i in asked}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def _answers(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [7, 60, 8192])
def test_top_k_equals_brute_force(spark, shard_rows):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(150)]  # a third of the rows are one vector
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, [1.0] * 5),
             (905, []), (20, [0.25] * 6), (906, [-0.0] * 6), (907, [1e6] * 6)]
    table = _vectors(spark, rows)
    asked = {i for i, _ in rows if i is not None and i % 20 == 0}
    found = kd_search.top_k(table, table.where("vec_id % 20 = 0"), 9, shard_rows=shard_rows)
    assert _answers(found) == _nearest(rows, asked, 9, 6)


def test_top_k_with_few_rows_and_huge_components(spark):
    few = [(1, [1.0, 2.0]), (2, [-1.0, 0.5]), (3, [0.0, 0.0])]
    table = _vectors(spark, few)
    assert _answers(kd_search.top_k(table, table, 20)) == _nearest(few, {1, 2, 3}, 20, 2)
    assert kd_search.top_k(table.where("false"), table, 20).collect() == []
    assert kd_search.top_k(table, table.where("false"), 20).collect() == []
    huge = _vectors(spark, [(1, [3e38, 1.0]), (2, [3e38, -1.0]), (3, [-3e38, 0.0])])
    limits = np.iinfo(np.int64)
    assert [(q, v, s) for q, _, v, s in _answers(kd_search.top_k(huge, huge.where("vec_id = 1"), 2))] == [(1, 2, limits.max), (1, 3, limits.min)]


def test_trees_bound_what_lies_in_them():
    rng = np.random.default_rng(2)
    rows = rng.integers(-50, 50, (500, 5))
    tree = kd_search.Tree.build(np.arange(500), rows, 16)
    queries = rng.integers(-50, 50, (20, 5))
    scores = queries @ tree.rows.T
    leaves = tree.open_leaves(queries, np.full(20, kd_search.NOTHING))
    for k, (low, high) in enumerate(zip(tree.ends, tree.ends[1:])):
        assert high - low <= 16 and (scores[:, low:high] <= leaves[:, k:k + 1]).all()
    # A floor closes leaves, and none that holds a score of at least the floor.
    floor = np.sort(scores, axis=1)[:, -5]
    closed = tree.open_leaves(queries, floor)
    assert (closed == kd_search.NOTHING).sum() > closed.size // 2
    for k, (low, high) in enumerate(zip(tree.ends, tree.ends[1:])):
        assert ((scores[:, low:high] < floor[:, None]).all(axis=1) | (closed[:, k] > kd_search.NOTHING)).all()
    assert kd_search.unpack(kd_search.pack(rows), 5).tolist() == rows.tolist()


def test_no_vectors_come_to_the_driver(spark, monkeypatch):
    # What each toArrow or collect brings; the vectors are 300 * 400 * 8 bytes.
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(400)]) for i in range(300)]
    table, brought = _vectors(spark, rows), []
    frame = type(table)

    def noted(f, size):
        def run(self, *a, **b):
            found = f(self, *a, **b)
            brought.append(size(found))
            return found
        return run

    monkeypatch.setattr(frame, "toArrow", noted(frame.toArrow, lambda t: t.nbytes))
    monkeypatch.setattr(frame, "collect", noted(frame.collect, lambda found: len(str(found))))
    found = kd_search.top_k(table, table.where("vec_id % 20 = 0"), 3, shard_rows=60)
    assert brought and max(brought) < 960_000 / 5
    assert _answers(found) == _nearest(rows, {i for i, _ in rows if i % 20 == 0}, 3, 400)


def test_queries_sent_to_shards_are_not_broadcast(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    table = _vectors(spark, rows)
    found = kd_search.top_k(table, table.where("vec_id % 20 = 0"), 3, shard_rows=20)
    joins = re.findall(r"(\w+Join) \[cell#\w+, part#\w+\]", found._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
    assert _answers(found) == _nearest(rows, {i for i, _ in rows if i % 20 == 0}, 3, 5)


def test_cells_are_few_where_boxes_are_wide(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    table = _vectors(spark, rows)
    sample = kd_search.whole_numbers(table, 64.0, "vec_id", "embedding").select("vector")
    assert len(kd_search._cells(sample, 6, 30)) == 32
    monkeypatch.setattr(kd_search, "BOX_VALUES", 60)
    assert len(kd_search._cells(sample, 6, 30)) == 8
    asked = {i for i, _ in rows if i % 20 == 0}
    assert _answers(kd_search.top_k(table, table.where("vec_id % 20 = 0"), 4, shard_rows=10)) == _nearest(rows, asked, 4, 6)
    monkeypatch.setattr(kd_search, "BOX_VALUES", 5)
    assert len(kd_search._cells(sample, 6, 30)) == 1 == len(kd_search._cells(sample.where("false"), 6, 30))


@pytest.mark.parametrize("kind", ["int8", "int64"])
def test_cells_halve_the_widest_dimension(kind):
    rng = np.random.default_rng(4)
    sample = rng.integers(-100, 100, (3000, 5)).astype(kind)
    sample[:, 3] = np.clip(sample[:, 3], -20, 20)
    cells = kd_search.Cells.learn(sample, 5)
    assert len(cells) == 8 and cells.dims[0] == int(np.argmax(sample.max(axis=0).astype(int) - sample.min(axis=0))) and 3 not in cells.dims
    assert cells.values[0] == np.sort(sample[:, cells.dims[0]])[1499]
    place = cells.of(sample.astype(np.int64))
    assert np.bincount(place).min() > 3000 / 8 * 0.9 and (place < 4).tolist() == (sample[:, cells.dims[0]] <= cells.values[0]).tolist()
    assert len(kd_search.Cells.learn(sample[:15], 5)) == 1 == len(kd_search.Cells.learn(sample[:0], 5))


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranking(docs, items, k):
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in _terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _case():
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "naïve", "漢字", "x1", "the", "of", "Ünder", "é"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(200)]
    docs += [(500 + i, "the copy of alpha") for i in range(100)]  # ties: a third of the rows
    docs += [(600, None), (601, ""), (602, " \n.,-"), (None, "alpha alpha"), (603, "rare"), (603, "rare"), (604, "big " + "filler-word, " * 120_000 + "alpha"),
             (605, "a\x00b under_score A_Z")]
    items = [(1, "Alpha the ALPHA"), (2, "nothing known"), (3, None), (4, "..."), (5, "漢字 rare"), (5, "rare"), (6, "big naïve a b under score z"), (1, "Alpha the ALPHA"),
             (7, "naÏve")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_ranking_equals_brute_force(spark, block_bytes):
    docs, items = _case()
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame(items, "item_id LONG, text STRING")
    found = lexical.rank_documents(table, asked, 7, block_bytes=block_bytes)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str) == _ranking(docs, items, 7)


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id LONG, text STRING")
    some = spark.createDataFrame([(1, "word")], "item_id LONG, text STRING")
    assert lexical.rank_documents(docs, some).collect() == [] and lexical.rank_documents(docs, items).collect() == []
    assert lexical.rank_documents(spark.createDataFrame([(1, "word", "x", "y")], DOCS), items).collect() == []


def test_heaps_keep_the_best_in_any_order():
    rng = np.random.default_rng(1)
    item, score, number = (rng.integers(0, n, 5000) for n in (3, 20, 4000))
    heaps = lexical.Heaps(3, 5)
    heaps.most = 50
    for part in np.array_split(np.arange(5000), 70):
        heaps.offer(item[part], score[part] + 1, number[part], np.zeros(len(part), bool))
    found = sorted(zip(*(x.tolist() for x in heaps.best()[:3])))
    expected = sorted(x for i in range(3) for x in sorted(((i, s + 1, n) for j, s, n in zip(item.tolist(), score.tolist(), number.tolist()) if j == i),
                                                          key=lambda x: (-x[1], x[2]))[:5])
    assert found == expected
