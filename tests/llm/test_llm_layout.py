"""Mixing, sharding and fingerprints against their laws."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from barloom.llm import fingerprints, mixing, sharding

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("slot", T.StringType()), T.StructField("cell", T.StringType()), T.StructField("key", T.StringType())])


def _table(spark, rows):
    return spark.createDataFrame([(i, t, s, "r", "s", "c", "k") for i, t, s in rows], SCHEMA)


def _rows():
    rows = [(i, "x" * (i % 90), ("a", "b", "c", None, "d")[min(i % 7, 4)]) for i in range(900)]
    return rows + [(None, "n", "a"), (3, None, "b"), (3, None, "b"), (5000, "y" * 3000, "a"), (5001, "", "b")]


@pytest.mark.parametrize("weights, other, block, resolution", [
    ({"a": 5, "b": 3}, 2, 100, 10), ({"a": 0.01, "b": 0.7, "c": 0.2}, 0.09, 50, 100), ({"zzz": 1}, 1, 1000, 7)])
def test_mix_is_pfair(spark, weights, other, block, resolution):
    rows = _rows()
    found = mixing.interleave(_table(spark, rows), weights, other, block, resolution, rows_per_bucket=100).collect()
    assert Counter((r.row.doc_id, r.row.text, r.row.source) for r in found) == Counter(rows)
    assert {r.mix_source for r in found} <= {*weights, mixing.OTHER}
    slots = {}
    for r in found:
        assert r.release <= r.slot < r.due
        assert slots.setdefault((r.mix_source, r.block), r.slot) == r.slot
    assert len(set(slots.values())) == len(slots)
    # Sizes along a source's blocks are gapless.
    ends = {}
    for r in sorted(found, key=lambda r: (r.mix_source, r.block, r["at"])):
        start = r.block * block + r["at"]
        assert start == ends.get(r.mix_source, 0)
        ends[r.mix_source] = start + r.size
    # Less than a block from the fluid share at every slot of the rounds in which no source ends.
    quota = mixing.quotas(weights, other, resolution)
    blocks = {s: -(-e // block) for s, e in ends.items()}
    full = min(blocks.get(s, 0) // q for s, q in quota.items()) if set(blocks) == set(quota) else 0
    length = sum(quota.values())
    for s, q in quota.items():
        for t in range(full * length):
            done = sum(1 for (n, b), at in slots.items() if n == s and at <= t)
            # Blocks inside a row longer than a block start no row; they count as placed in their window.
            skipped = sum(1 for b in range(full * q) if (s, b) not in slots and b * length // q <= t)
            assert abs(done + skipped - q * (t + 1) / length) < 1 + (skipped > 0)


def test_schedule_of_equal_rounds_meets_every_window(spark):
    totals = spark.createDataFrame([("a", 500), ("b", 300), ("other", 41)], "mix_source string, blocks long")
    plan = mixing.schedule(totals, {"a": 7, "b": 11, "other": 2}).collect()
    assert all(r.release <= r.pos < r.due for r in plan)
    for (first, length), n in Counter((r.first_round, r.L) for r in plan).items():
        assert n == length
    for first in {r.first_round for r in plan}:
        one = sorted((r for r in plan if r.first_round == first), key=lambda r: r.pos)
        count = Counter(r.mix_source for r in one)
        for s, c in count.items():
            done = 0
            for t, r in enumerate(one, 1):
                done += r.mix_source == s
                assert abs(done - c * t / len(one)) < 1


def test_mixed_rows_are_whole_and_ordered(spark):
    docs = _table(spark, _rows())
    got = mixing.mixed(docs, {"a": 5, "b": 3}, 2, 100, 10)
    assert got.columns == docs.columns and Counter(got.collect()) == Counter(docs.collect())
    assert mixing.mixed(docs.limit(0), {"a": 1}, 1, 10).count() == 0


@pytest.mark.parametrize("weights, other", [({"a": 0}, 1), ({"a": -1}, 1), ({"other": 1}, 1), ({"a": float("nan")}, 1)])
def test_bad_weights_are_refused(weights, other):
    with pytest.raises(ValueError):
        mixing.quotas(weights, other, 10)


@pytest.mark.parametrize("shards, hot", [(24, 0), (5, 900), (1, 10)])
def test_shards_are_near_equal_and_gapless(spark, shards, hot):
    rows = _rows() + [(10_000 + i, "hot text " * 5, "a") for i in range(hot)] + [(20_000 + i, f"pair {i // 2} " * 3, "a") for i in range(200)]
    found = sharding.shard_by_bytes(_table(spark, rows), shards).collect()
    expected = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=str) == expected
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in found)
    sizes, slots = Counter(), {}
    for r in found:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total = sum(sizes.values())
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(shards)) <= 2 * max(4000, sharding.KEEP_TOGETHER * total / shards)
    places = {}
    for r in found:
        places.setdefault(r.text_crc32, set()).add(r.shard)
    small = {c: p for c, p in places.items() if sum(r.size for r in found if r.text_crc32 == c) <= sharding.KEEP_TOGETHER * total / shards}
    assert all(len(p) == 1 for p in small.values())


def test_sharding_an_empty_table(spark):
    assert sharding.shard_by_bytes(_table(spark, _rows()).limit(0), 24).count() == 0


def _jaccard(a, b):
    a, b = (Counter(t.lower().split()) for t in (a, b))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


@pytest.mark.parametrize("cells", [7, 10_000])
def test_fingerprints_follow_order_and_similarity(spark, cells):
    rng = __import__("random").Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randint(0, 80))), "a") for i in range(120)]
    rows += [(100, rows[4][1], "a"), (101, None, "a"), (103, "", "a"), (104, "🙂é" * 21, "a"), (106, "w" * 200_000, "a")]
    found = {r.doc_id: r for r in fingerprints.fingerprints(_table(spark, rows), rows_per_cell=cells).collect()}
    text = {i: t or "" for i, t, _ in rows}
    order = sorted(text, reverse=True)
    errors = []
    for at, i in enumerate(order):
        t, after = text[i], text[order[(at + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.split() and edited.split() and after.split():
            errors += [r.near_edited - _jaccard(t, edited), r.near_next - _jaccard(t, after)]
    assert abs(sum(errors) / len(errors)) < 0.02 and (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1
    assert found[100].fingerprint == found[12].fingerprint and found[101].fingerprint == found[103].fingerprint
    assert len({r.fingerprint for r in found.values()}) > 100


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (1, "e f g h", "s"), (None, "i j k l", "s"), (None, "m n o p", "s"), (None, None, "s")]
    found = fingerprints.fingerprints(_table(spark, rows), rows_per_cell=2)
    assert found.count() == 6 and found.where("fingerprint IS NULL OR near_next IS NULL").count() == 0
    one = fingerprints.fingerprints(_table(spark, [(1, "a b c d", "s")])).first()
    assert one.near_next == 1.0
    assert fingerprints.fingerprints(_table(spark, rows).limit(0)).count() == 0
