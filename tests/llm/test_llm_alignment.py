"""Alignment of two tokenizations against a plain walk over the bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from barloom.llm import alignment
from barloom.llm.sentence_pieces import MODEL, load

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType()),
    T.StructField("n_a", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("kind", T.StringType())])


@pytest.fixture(scope="module")
def files():
    return load(alignment.VOCABULARY), load(MODEL)


@pytest.fixture(scope="module")
def plain(files):
    """Ids and byte ranges of both sides, straight from the two libraries."""
    a = Tokenizer.from_str(files[0].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    letters = alignment._byte_letters()

    def sides(text):
        data = b" " + (text or "").encode()
        if len(data) == 1:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids
        first = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
        second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
                  for i in b.encode(text)]
        return (first, second) if all(b"".join(x for _, x in s) == data for s in (first, second)) else None
    return sides


def _ranges(side):
    at, found = 0, []
    for i, data in side:
        found.append((i, at, at + len(data)))
        at += len(data)
    return found


def _expected(rows, sides):
    linked, parts = [], []
    for _, text in rows:
        both = sides(text)
        links, groups = [], []
        if both:
            a, b = map(_ranges, both)
            ends = sorted({e for *_, e in a} & {e for *_, e in b})
            waiting = [a[::-1], b[::-1]]
            for end in ends:
                own = [[], []]
                for k in (0, 1):
                    while waiting[k] and waiting[k][-1][2] <= end:
                        own[k].append(waiting[k].pop())
                groups.append(own)
                links += [(x[0], y[0]) for x in own[0] for y in own[1] if x[1] < y[2] and y[1] < x[2]]
        linked.append(links)
        parts.append((both, groups))
    count = Counter(p for links in linked for p in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    result = []
    for (i, _), links, (both, groups) in zip(rows, linked, parts):
        shown = ";".join("|".join(",".join(str(t[0]) for t in side) for side in g) for g in groups)
        result.append((i, len(both[0]) if both else 0, len(both[1]) if both else 0, len(groups), len(links),
                       sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links),
                       hashlib.sha256(shown.encode()).hexdigest() if both else ""))
    return result


def _found(df):
    return [tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()]


ODD = [None, "", " ", "  ", "a", "a  b", " a ", "\n\n", "Hello, wörld! 漢字 ① é́ <|endoftext|> <s></s> <0x41>", "▁marked▁", "x\x00y",
       "tab\tand\r\nlines", "👩‍👩‍👧 family", "don't can't 'll", "0123456789" * 5]


def test_rows_equal_a_plain_walk(spark, files, plain):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma,", "naïve", "x1y2", "漢字", "tokenization", "internationally", "\n", "(a)", "don't", "ﬁ", " "]
    long = [" ".join(rng.choices(words, k=n)) for n in (200, 2500, 9000)] + ["é" * 30_000, "a " * 20_000, "▁ x" * 9000]
    rows = [(i, t) for i, t in enumerate(ODD + long)] + [(3, "same"), (3, "same"), (None, "same words"), (99, "Hello, wörld!")]
    docs = spark.createDataFrame([(i, t, "k", "n", "c", "z") for i, t in rows], SCHEMA).repartition(3)
    expected = sorted(_expected(rows, plain), key=str)
    assert sorted(_found(alignment.align_tokenizers(docs, *files)), key=str) == expected
    assert sum(r[1] == 0 for r in expected) == 4
    # The byte ranges of fragments change nothing.
    assert sorted(_found(alignment.align_tokenizers(docs, *files, fragment_bytes=97)), key=str) == expected


def test_given_documents_equal_a_plain_walk(spark, files, plain):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(_found(alignment.align_tokenizers(docs, *files))) == sorted(_expected(rows, plain))


def test_empty_table(spark, files):
    assert alignment.align_tokenizers(spark.createDataFrame([], SCHEMA), *files).collect() == []


def test_composition_is_associative(files):
    rng = random.Random(3)
    tokens = alignment._tokenizers(*files)
    text = (" " + " ".join(rng.choices(["internationalisation", "naïveté", "x", "漢字", "don't"], k=400))).encode()
    a, b = tokens.encode([text])[0]
    leaves = [f for _, f, _ in alignment.fragments(a, b, 0, 7)]

    def fold(parts, deal):
        closed = []
        while len(parts) > 1:
            k = deal(len(parts) - 1)
            made, group = alignment.compose(parts[k], parts[k + 1])
            closed += [group] if group else []
            parts = [*parts[:k], made, *parts[k + 2:]]
        return parts[0], sorted((at, g[0][0].tolist(), g[1][0].tolist()) for at, g in closed)

    def shape(fragment):
        return [side[k].tolist() for ends in (fragment.prefix, fragment.suffix) for side in ends for k in (0, 1)], fragment.first

    left, closed = fold(leaves, lambda n: 0)
    for deal in (lambda n: n - 1, lambda n: rng.randrange(n), lambda n: n // 2):
        other, same = fold(leaves, deal)
        assert shape(other) == shape(left) and same == closed
    assert any(f.first is None for f in leaves) and len(closed) > 50


def test_planes_and_cuts(files):
    for values in ([], [0], [255, 3], [256, 0, 70_000], [1 << 40, 2]):
        assert alignment.from_planes(alignment.planes(np.array(values, np.int64))).tolist() == values
    data = b" " + b"word  and\xc2\xa0 more " * 50
    pieces = alignment.cut_text(data, 40)
    assert b"".join(pieces) == data and all(p[:1] == b" " and len(p) > 1 for p in pieces) and len(pieces) > 10
    assert alignment.cut_text(b" " + b"x" * 500, 40) == [b" " + b"x" * 500]


def test_other_vocabularies_use_their_own_file(files):
    import json
    settings = json.loads(files[0])
    settings["model"]["merges"] = settings["model"]["merges"][::-1]
    tokenizers = alignment.Tokenizers(json.dumps(settings).encode(), files[1])
    theirs = Tokenizer.from_str(json.dumps(settings))
    assert list(tokenizers.encode_a(" some tokenization")) == theirs.encode(" some tokenization").ids
