"""Exact duplicates, near-duplicate join and components against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from barloom.llm import components as parts
from barloom.llm import exact_dedup, ngram_join
from barloom.llm.common import settle
from barloom.llm.components import components
from barloom.llm.shingles import shingle_set, word_hashes

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()),
    T.StructField("tag", T.LongType()), T.StructField("node", T.StringType()), T.StructField("text_tag", T.StringType())])


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "n", "g") for i, t in rows], SCHEMA)


def test_exact_duplicates_equal_brute_force(spark):
    rows = [(5, "Hello Wörld"), (9, "hELLO wörld"), (2, "hello WÖRLD"), (None, "hello wörld"), (7, None), (8, ""), (3, "z" * 500_000), (4, "Z" * 500_000),
            (11, "same"), (11, "same"), (12, "SAME")] + [(100 + i, "hot") for i in range(300)]
    found = exact_dedup.exact_duplicates(_table(spark, rows), rows_per_run=3).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(_fold(t), []).append(i)
    expected = sorted(((i, max((x for x in groups[_fold(t)] if x is not None), default=None), len(groups[_fold(t)]),
                        hashlib.sha256(_fold(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    # The number of rounds changes nothing.
    again = exact_dedup.exact_duplicates(_table(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_exact_duplicates_smallest_and_rows_that_stay(spark):
    docs = _table(spark, [(5, "A"), (2, "a"), (None, "a"), (6, "b"), (6, "b"), (None, "c"), (None, "c")])
    assert {r.keep_id for r in exact_dedup.exact_duplicates(docs, keep="smallest").collect()} == {2, 6, None}
    stays = exact_dedup.drop_exact_duplicates(docs)
    assert stays.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in stays.collect()) == [("5", "A"), ("6", "b"), ("None", "c")]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def _shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", _fold(text))
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _brute(rows, width, percent):
    sets = [_shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def _families(seed, width):
    """Families of edited copies around the threshold, a common passage, and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    rows, next_id = [], 1000
    for size in (60, 25, 5, 3, 2, 2, 1, 1):
        base = rng.choices(words, k=rng.randint(30, 160))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // (5 * width)))):
                text[rng.randrange(len(text))] = f"v{rng.randint(0, 9999)}"
            rows.append((next_id, " ".join(text)))
            next_id -= 1
    rows += [(next_id - i, " ".join(passage + rng.choices(words, k=rng.randint(2, 9)))) for i in range(40)]
    return rows + [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (None, "one two"), (None, "lonely null id here now"),
                   (7, "a b c d e f"), (7, "a b c d e f"), (8, "x " * 30_000), (9, "X\t" * 30_000)]


@pytest.mark.parametrize("seed, width, percent, rounds", [(1, 4, 85, 3), (2, 5, 80, 3), (3, 4, 85, 0), (4, 2, 60, 1), (5, 4, 100, 3)])
def test_similar_sets_equal_brute_force(spark, seed, width, percent, rounds):
    rows = _families(seed, width)
    found = ngram_join.similar_sets(_table(spark, rows), width, percent, star_rounds=rounds).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == sorted(_brute(rows, width, percent), key=str)


def test_one_row_of_each_component_stays(spark):
    rows = _families(6, 5)
    docs = _table(spark, rows)
    stays = ngram_join.keep_one_of_each(docs, 5, 80)
    assert stays.columns == docs.columns
    empty = {1, 2, 3}
    expected = {c for d, n, c in _brute(rows, 5, 80) if n} | empty
    got = [r.doc_id for r in stays.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty_table_and_tables_without_links(spark):
    docs = _table(spark, [(1, "a b c d e"), (2, "f g h i j")])
    assert ngram_join.similar_sets(docs.limit(0), 4, 85).count() == 0
    assert {r.component_id for r in ngram_join.similar_sets(docs, 4, 85).collect()} == {1, 2}


def test_word_hashes_follow_the_definition():
    texts = ["A b C", None, "", "　x y", "é É", "q" * 3_000_000, ("ab " * 800_000) + "end", "t\x0bu\x0cv\x85w", "last"]
    found = dict(word_hashes(pa.array(texts)))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", _fold(t)) for t in texts]
    assert [len(found[i]) for i in range(len(texts))] == list(map(len, plain))
    names = {}
    for i, words in enumerate(plain):
        for h, w in zip(found[i].tolist(), words):
            assert names.setdefault(h, w) == w
    assert len(shingle_set(found[6], 4)) == len(_shingles(texts[6], 4))


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(3)
    order = rng.sample(range(200), 200)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(500, i) for i in range(501, 560)] + [(900, 900)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in order}, **{i: 500 for i in range(500, 560)}}


def _jobs(spark, name, work):
    """What ``work`` returns, and the number of Spark jobs it took."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        return work(), len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_random_edges_and_of_stars_in_few_jobs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)]
    edges += [(v, u) for u, v in edges[:30]] + edges[:10]
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len(label) and {r.node: r.label for r in found} == label
    stars = spark.createDataFrame([(hub, hub + i) for hub in (0, 100, 200) for i in range(1, 40)] + [(7, 7)], "u long, v long")
    done, jobs = _jobs(spark, "stars", lambda: components(stars))
    assert done.count() == 3 * 40 and jobs <= 6  # stars are the result as they are


def test_labels_after_new_links_take_few_jobs(spark):
    links = ngram_join._Links(None, 85)
    links._join(spark.createDataFrame([(1, 2), (2, 3), (10, 11), (20, 21)], "u long, v long"))
    _, jobs = _jobs(spark, "labels", lambda: links._join(spark.createDataFrame([(3, 11), (30, 31), (21, 20)], "u long, v long")))
    assert {r.node: r.label for r in links.labels.collect()} == {**dict.fromkeys((1, 2, 3, 10, 11), 1), **dict.fromkeys((20, 21), 20), **dict.fromkeys((30, 31), 30)}
    assert links.labels.count() == 9 and jobs <= 20


def test_a_round_of_components_and_a_turn_of_links_take_few_jobs(spark):
    edges = settle(spark.createDataFrame([(4, 1), (4, 2), (5, 4), (6, 5), (9, 8)], "u long, v long"), "edges")
    done, jobs = _jobs(spark, "round", lambda: settle(parts._round(edges), "round"))
    # 5 and 6 are handed to the smallest neighbour of 4 and 5, then 2 and 4 meet at 1.
    assert sorted(map(tuple, done.collect())) == [(2, 1), (4, 1), (5, 1), (6, 4), (9, 8)] and jobs <= 5
    _, jobs = _jobs(spark, "unfinished", lambda: parts._unfinished(edges))
    assert jobs <= 3
    sets = settle(spark.createDataFrame([(n, list(range(n // 10 * 100, n // 10 * 100 + 40))) for n in (1, 2, 3, 11, 12, 21)], "node long, tokens array<long>"), "whole")
    links = ngram_join._Links(sets, 85)
    links._join(spark.createDataFrame([(1, 2), (11, 12)], "u long, v long"))
    # Twice (2, 3), whose sets are equal, and (3, 21), whose sets are not.
    pairs = settle(spark.createDataFrame([(2, 3, 1, 3), (2, 3, 1, 3), (3, 21, 3, 21)], "u long, v long, lu long, lv long"), "partners")
    new, jobs = _jobs(spark, "turn", lambda: links.add(pairs))
    assert new == 1 and {r.node: r.label for r in links.labels.collect()} == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11}
    assert jobs <= 24
