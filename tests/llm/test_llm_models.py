"""Token counts, SentencePiece and the quality ranking against full recounts, the reference implementation and held-out rows."""

import random
import struct
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import quality, sentence_pieces, token_counts

SF = "/root/testdata/sf0.01"
ODD = ["", " ", "  a", "a  b ", "\n\n x", "<s> </s> <unk> <0x41>", "日本語 🙂 ع", "▁▁a▁b", "\x01\x02", "tab\tx  ", "é" * 300, "x " * 40_000, "y" * 100_000,
       "it's we'll   \n\n\n  end   ", "12,345.67 +-*/ ''''", "   wide"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()),
                       T.StructField("edits", T.StringType()), T.StructField("score", T.StringType())])


def _table(spark, texts):
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)] + [(None, None, None, None, None), (1, " ", "a", "b", "c")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.load(token_counts.VOCABULARY), token_counts.PATTERN)


@pytest.mark.parametrize("seed", range(8))
def test_counts_after_edits_equal_a_full_recount(counter, seed):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "word", "Word's", "é", "12", "...", "\t \n", " a", "'", "🙂", "ll "]
    text = "".join(rng.choices(bits, k=rng.choice([0, 1, 5, 200, 3000])))
    tree = token_counts.CountTree(text, counter)
    for _ in range(120):
        at, removed = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 40])
        inserted = "".join(rng.choices(bits, k=rng.choice([0, 0, 1, 2, 7]))) if rng.random() < 0.95 else "big " * 700
        tree.edit(at, removed, inserted)
        at = min(max(at, 0), len(text))
        text = text[:at] + inserted + text[at + min(removed, len(text) - at):]
        pieces = counter.pattern.findall(text)
        assert tree.text == text and tree.total == len(counter.encoding.encode_ordinary(text))
        assert [n for b in tree.blocks for n in b[0]] == list(map(len, pieces)) and tree.chars[1] == len(text)


def test_an_edit_recounts_little(counter):
    tree = token_counts.CountTree("some words of prose, and more. " * 2000, counter)
    tree.edit(30_000, 3, "new")
    assert tree.recounted < 12


def test_token_count_operator(spark, counter):
    docs = _table(spark, ODD)
    edits = F.array(F.struct(F.lit(2).alias("at"), F.lit(3).alias("removed"), F.lit(" zz ").alias("inserted")), F.lit(None))
    found = token_counts.count_tokens(docs, token_counts.load(token_counts.VOCABULARY), edits).collect()
    assert len(found) == docs.count()
    for r in found:
        text = (ODD[r.doc_id] if r.doc_id is not None else "")
        after = text[:2] + " zz " + text[5:]
        assert (r.n_tokens, r.edited_n_tokens, r.edited_n_chars, r.n_edits) == (
            len(counter.encoding.encode_ordinary(text)), len(counter.encoding.encode_ordinary(after)), len(after), 1)
    plain = token_counts.count_tokens(docs, token_counts.load(token_counts.VOCABULARY))
    assert plain.where("n_edits = 0 AND n_tokens = edited_n_tokens").count() == docs.count()
    assert token_counts.count_tokens(docs.limit(0), token_counts.load(token_counts.VOCABULARY)).count() == 0
    table = spark.createDataFrame([(2, 1, 0, 0, "b"), (2, 0, 0, 1, "a")], "doc_id long, seq int, at int, removed int, inserted string")
    joined = token_counts.edits_of(docs.drop("edits"), table).where("doc_id = 2").first()
    assert [e.inserted for e in joined.edits] == ["a", "b"]


def test_pieces_equal_the_reference_implementation(spark):
    model = sentence_pieces.load(sentence_pieces.MODEL)
    other = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = _table(spark, ODD)
    found = sentence_pieces.encode(docs, model)
    rows = found.collect()
    assert len(rows) == docs.count() and all(r.parity for r in rows)
    for r in rows:
        text = ODD[r.doc_id] if r.doc_id is not None else ""
        assert r.token_ids == other.encode(text) and r.n_tokens == len(r.token_ids)
        assert r.n_byte_tokens == sum(other.is_byte(i) for i in r.token_ids) and r.n_unknown == 0
        assert r.round_trip == (other.decode(r.token_ids) == text)
    back = {r.doc_id: r.text for r in sentence_pieces.decode(found, model).collect()}
    assert all(back[i] == other.decode(other.encode(t)) for i, t in enumerate(ODD))
    assert sentence_pieces.encode(docs.limit(0), model).count() == 0
    whole = sentence_pieces.encode(spark.read.parquet(f"{SF}/documents.parquet"), model)
    assert whole.where("NOT parity OR NOT round_trip").count() == 0


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += _varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += _varint(number << 3) + _varint(value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


@pytest.mark.parametrize("fallback, collapse", [(0, 0), (1, 0), (0, 1), (1, 1)])
def test_a_hand_made_unigram_model_has_parity(fallback, collapse):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else [])
    pieces += [(p, -float(k + 1), 1) for k, p in enumerate(["▁", "a", "b", "ab", "▁a", "▁ab", "aba", "c", "▁▁", "bc"])]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (35, fallback))), (3, _message((1, b"identity"), (3, 1), (4, collapse), (5, 1))))
    ours, other = sentence_pieces.build(sentence_pieces.parse(data)), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ["", "ab", "abab c", "a  b", " bc ab ", "zéb", "cabac abc", "  ", "a   "]:
        assert ours.encode(text, add_special_tokens=False).ids == other.encode(text), text


def test_ranking_learns_and_never_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.fit(docs, labels)
    found = quality.classify(docs, ranking).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.score for r in found if r.held_out and truth.get(r.doc_id) == 1]
    bad = [r.score for r in found if r.held_out and truth.get(r.doc_id) == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, flipped) == ranking


def test_ranking_of_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.fit(docs, labels)
    odd = _table(spark, ODD)
    found = quality.classify(odd, ranking).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id is None or (r.doc_id is not None and ODD[r.doc_id] == "")}) == 1
    assert quality.classify(odd.limit(0), ranking).count() == 0
    kept = quality.drop_rejected(odd, ranking)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in found)
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.classify(odd, nothing).where("predicted = 0").count() == 0


def _prose(i):
    """Good rows are prose, bad ones marks."""
    good = F.concat(F.lit("the words of "), i.cast("string"), F.lit(" are plain and long enough to read."))
    return F.when(i % 6 > 0, good).otherwise(F.concat(F.lit("!!! | | "), i.cast("string"), F.lit(" !!!")))


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    """27,000 labelled rows, more than a sample of 20,000 would hold."""
    ids = spark.range(27_000).select(F.col("id").alias("doc_id"))
    docs, labels = ids.withColumn("text", _prose(F.col("doc_id"))), ids.withColumn("quality", (F.col("doc_id") % 6 > 0).cast("int"))
    written = []
    settle = quality.settle
    monkeypatch.setattr(quality, "settle", lambda df, label: written.append(settle(df, label)) or written[-1])
    ranking = quality.fit(docs, labels)
    assert written[0].count() == labels.where(~quality.held_out()).count() > 20_000
    found = quality.classify(docs, ranking).join(labels, "doc_id")
    assert found.where("predicted = quality").count() > 0.9 * 27_000


@pytest.mark.parametrize("good, bad", [(30_000, 30_000), (60_000, 700), (40_000, 9), (300, 300)])
def test_every_row_is_in_a_pair_and_pairs_grow_with_the_rows(spark, good, bad):
    rows = spark.range(good + bad).select("id", (F.col("id") >= bad).cast("double").alias("label"), F.xxhash64("id", F.lit(5)).alias("dice"),
                                          *[F.lit(0.0).alias(f) for f in quality.FEATURES])
    counts = {0.0: bad, 1.0: good}
    groups = quality.dealt(rows, counts).groupBy("bucket", "slot").agg(
        F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    assert all(g.good and g.bad for g in groups) and sum(g.good + g.bad for g in groups) == good + bad
    pairs = sum(g.good * g.bad for g in groups)
    assert pairs == good * bad if good * bad <= quality.PAIRS else pairs <= 2 * max(quality.PAIRS, quality.PAIRS_A_ROW * (good + bad))
