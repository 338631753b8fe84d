"""Alignment of two tokenizations of the same text by the bytes they cover.

Tokenizer A (byte-level BPE) reads a blank and the text, tokenizer B (a
SentencePiece model) the text, whose dummy prefix is that blank. Where a token of
A and one of B end at the same byte, a group ends. Within groups, tokens whose
byte ranges overlap are linked.

Short documents are aligned where they are read. A long one is cut before blanks
that no token of either side can span, its pieces are dealt out and encoded, and
the tokens fall into byte ranges that know nothing of tokens. Such a fragment is
an element of a monoid: an open prefix up to its first common end, closed groups,
and an open suffix behind its last. Joining two neighbours closes the group
between them, whichever neighbours are joined first, so the fragments of a
document are reduced as a tree across tasks. Closed groups leave the tree as soon
as they are known and only open ends are carried upward.

Corpus-wide counts of linked id pairs are gathered by chunks: a chunk of texts
keeps its distinct pairs and the spread of their links over its documents, asks
for the pairs' counts once each, and applies the answer to its documents. Neither
the links nor the counts pass through the driver, and no table of counts is
broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm.common import quote, settle
from barloom.llm.sentence_pieces import MARK, parse
from barloom.llm.token_counts import PATTERN

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Text per chunk; documents above LONG_BYTES are cut into pieces of about that size.
CHUNK_BYTES = 1 << 20
SLICE_BYTES = 1 << 18
CHUNK_ROWS = 1 << 16
LONG_BYTES = 1 << 15
FRAGMENT_BYTES = 1 << 13
FAN_IN = 16

BLANK_RUN = 20_000
_BLANKS = re.compile(rf"\s{{{BLANK_RUN}}}")

DOCUMENT, CHUNK, PIECE = 0, 1, 2
FRAGMENT, GROUPS = 0, 1


class Side(tuple):
    """Tokens in order: their ids and their lengths in bytes."""

    def __new__(cls, ids, lengths):
        return super().__new__(cls, (np.asarray(ids, np.int32), np.asarray(lengths, np.int32)))

    def __add__(self, other):
        return Side(*(np.concatenate(x) for x in zip(self, other)))

    def cut(self, low: int, high: int) -> Side:
        return Side(self[0][low:high], self[1][low:high])

    def packed(self) -> bytes:
        return np.concatenate(self).tobytes()

    @staticmethod
    def of(data: bytes) -> Side:
        return Side(*np.frombuffer(data, np.int32).reshape(2, len(data) // 8))


def _byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, from their files' bytes, and the bytes of every id."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece

        settings = json.loads(vocabulary)
        letters = _byte_letters()
        ids = settings["model"]["vocab"]
        self.a_bytes = [b""] * (max([*ids.values(), *(t["id"] for t in settings["added_tokens"])], default=-1) + 1)
        added = {t["content"]: t["id"] for t in settings["added_tokens"]}
        for text, i in ids.items():
            self.a_bytes[i] = text.encode() if text in added else bytes(letters[c] for c in text)
        self.by_rank = self._by_rank(settings, added)
        self.vocabulary = vocabulary
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        parsed = parse(model)
        self.b_bytes = [bytes([self._byte(p)]) if self._byte(p) >= 0 else p.replace(MARK, " ").encode() for p, _, _ in parsed.pieces]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int32) for t in (self.a_bytes, self.b_bytes))
        # A cut before a blank is safe if no piece holds a blank behind another character and nothing rewrites blanks.
        self.cuts = parsed.dummy_prefix and not parsed.collapse_spaces and not parsed.charsmap and not any(
            MARK in p.lstrip(MARK) for p, _, _ in parsed.pieces)
        wide = max(len(self.a_bytes), 1)
        self.wide, self.many = wide, len(self.b_bytes)
        # Ids as text with what follows: A's last of a group, B's last of a group, any other.
        numbers = [str(i) for i in range(max(wide, len(self.b_bytes)))]
        self.shown = np.array([(n + mark).encode() for mark in "|;," for n in numbers], object)
        self.shown_step = len(numbers)

    @staticmethod
    def _byte(piece: str) -> int:
        return int(piece[3:5], 16) if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">") else -1

    def _by_rank(self, settings: dict, added: dict):
        """Merging by rank needs no file of merges where each merge makes the next id; most vocabularies are so."""
        import tiktoken

        steps, core = settings["pre_tokenizer"] or {}, settings["model"]
        made = [core["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in core["merges"]]
        plain = (settings["normalizer"] is None and steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True)
                 and core.get("type") == "BPE" and not core.get("dropout") and not core.get("ignore_merges")
                 and None not in made and made == sorted(set(made)))
        ranks = {self.a_bytes[i]: i for t, i in core["vocab"].items() if t not in added}
        if not plain or any(bytes([b]) not in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def by_file(self):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(self.vocabulary.decode())
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode_a(self, text: str) -> list[int]:
        # The faster backend's expression engine gives up on white space of that length.
        if self.by_rank is None or len(text) > BLANK_RUN and _BLANKS.search(text):
            return self.by_file(text)
        return self.by_rank(text)

    def encode(self, texts: list[bytes]) -> list[tuple[Side, Side] | None]:
        """Both sides of texts that begin with their blank; nothing where a side's bytes differ from the text."""
        plain = [t.decode() for t in texts]
        found = []
        for text, a, b in zip(texts, map(self.encode_a, plain), self.pieces.encode([t[1:] for t in plain], num_threads=1)):
            same = b"".join(map(self.a_bytes.__getitem__, a)) == text and b"".join(map(self.b_bytes.__getitem__, b)) == text
            found.append((Side(a, self.a_lengths[a]), Side(b, self.b_lengths[b])) if same else None)
        return found


@lru_cache(maxsize=2)
def _tokenizers(vocabulary: bytes, model: bytes) -> Tokenizers:
    return Tokenizers(vocabulary, model)


def cut_text(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes; each but the first begins with a blank that follows a visible ASCII character."""
    pieces, low = [], 0
    while len(data) - low > size:
        at = low + size
        while (at := data.find(b" ", at, len(data) - 1)) >= 0 and not 33 <= data[at - 1] <= 126:
            at += 1
        if at < 0:
            break
        pieces.append(data[low:at])
        low = at
    return [*pieces, data[low:]]


@dataclass
class Aligned:
    """A run of parts, each a series of whole groups."""

    texts: list[bytes]
    groups: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    spread: bytes


def planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, byte by byte of equal weight, which packs well."""
    kind = np.dtype(next(k for k in "BHIQ" if not len(values) or int(values.max()) <= np.iinfo(k).max))
    return kind.char.encode() + values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(kind.itemsize, -1).T).view(kind).ravel().astype(np.int64)


def align(parts: list[tuple[Side, Side]], tokenizers: Tokenizers) -> Aligned:
    """Groups and links of parts whose two sides cover equal bytes."""
    a, b = (Side(*(np.concatenate(x) for x in zip(*(p[k] for p in parts)))) for k in (0, 1))
    sizes = np.array([p[0][1].sum() for p in parts], np.int64)
    part_ends = np.cumsum(sizes)
    total = int(part_ends[-1])
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    a_ends, b_ends = np.cumsum(a[1]), np.cumsum(b[1])
    is_a[a_ends], is_b[b_ends] = True, True
    common = is_a & is_b
    # Tokens that end at or before each byte.
    upto_a, upto_b = np.cumsum(is_a, dtype=np.int32), np.cumsum(is_b, dtype=np.int32)
    closes = np.flatnonzero(common)
    group_of = np.cumsum(common, dtype=np.int32) - common
    a_group, b_group = group_of[a_ends], group_of[b_ends]
    # A's tokens of a group come first, then B's.
    before_b = np.concatenate(([0], upto_b[closes]))
    place_a = np.arange(len(a_ends)) + before_b[a_group]
    place_b = np.arange(len(b_ends)) + upto_a[closes][b_group]
    shown = np.empty(len(a_ends) + len(b_ends), np.int32)
    shown[place_a] = np.where(common[a_ends], 0, 2) * tokenizers.shown_step + a[0]
    shown[place_b] = np.where(common[b_ends], 1, 2) * tokenizers.shown_step + b[0]
    text_ends = (upto_a[part_ends] + upto_b[part_ends]).tolist()
    texts = [b"".join(tokenizers.shown[shown[low:high]].tolist()) for low, high in zip([0, *text_ends], text_ends)]
    # Between two neighbouring ends of either side lies one link.
    ends = np.flatnonzero(is_a | is_b)
    pair = a[0][upto_a[ends] - is_a[ends]].astype(np.int64) * tokenizers.many + b[0][upto_b[ends] - is_b[ends]]
    part = np.searchsorted(part_ends, ends)
    groups = np.diff(group_of[part_ends] + 1, prepend=0)
    links = np.bincount(part, minlength=len(parts))
    key = np.sort(pair * len(parts) + part)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    pair, part = key // len(parts), key % len(parts)
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    step = np.diff(part, prepend=0)
    step[first] = part[first]
    spread = [planes(x) for x in (np.diff(np.append(first, len(pair))), step, times)]
    head = np.array([len(s) for s in spread], np.int64).tobytes()
    return Aligned(texts, groups, links, pair[first], np.add.reduceat(times, first), head + b"".join(spread))


def spread_out(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair number, part, links) entries of a chunk."""
    at, arrays = 24, []
    for size in np.frombuffer(data[:24], np.int64):
        arrays.append(from_planes(data[at:at + size]))
        at += size
    runs, step, times = arrays
    first = np.cumsum(runs) - runs
    total = np.cumsum(step)
    part = total - np.repeat(total[first] - step[first], runs)
    return np.repeat(np.arange(len(runs)), runs), part, times


# ---------------------------------------------------------------- the fragment monoid

@dataclass
class Fragment:
    """Open prefix (with the end that closes it, if there is one), closed groups elsewhere, open suffix.

    ``first`` is the byte where the leaf with the first common end begins, or
    nothing where there is none; then all tokens are in the prefix.
    """

    prefix: tuple[Side, Side]
    first: int | None
    suffix: tuple[Side, Side]


def _join(x: tuple[Side, Side], y: tuple[Side, Side]) -> tuple[Side, Side]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, tuple[int, tuple[Side, Side]] | None]:
    """The fragment of both, and the group that this closes with the leaf where it ends."""
    if x.first is None:
        return Fragment(_join(x.prefix, y.prefix), y.first, y.suffix), None
    between = _join(x.suffix, y.prefix)
    if y.first is None:
        return Fragment(x.prefix, x.first, between), None
    return Fragment(x.prefix, x.first, y.suffix), (y.first, between)


def fragments(a: Side, b: Side, start: int, size: int) -> Iterator[tuple[int, Fragment, tuple[Side, Side] | None]]:
    """A piece's tokens by byte ranges of ``size``: the byte where each begins, its fragment, and the groups closed inside it."""
    ends = [start + np.cumsum(s[1]) for s in (a, b)]
    stop = int(ends[0][-1])
    low, leaf = [0, 0], start
    for bound in [*range((start // size + 1) * size, stop, size), stop]:
        high = [int(np.searchsorted(e, bound, side="right")) for e in ends]
        common = np.intersect1d(ends[0][low[0]:high[0]], ends[1][low[1]:high[1]], assume_unique=True)
        cuts = [[int(np.searchsorted(e, c, side="right")) for e in ends] for c in (common[:1].tolist() + common[-1:].tolist())]
        if cuts:
            first, last = cuts
            yield leaf, Fragment(tuple(s.cut(l, c) for s, l, c in zip((a, b), low, first)), leaf,
                           tuple(s.cut(c, h) for s, c, h in zip((a, b), last, high))), (
                tuple(s.cut(f, c) for s, f, c in zip((a, b), first, last)) if len(common) > 1 else None)
        else:
            yield leaf, Fragment(tuple(s.cut(l, h) for s, l, h in zip((a, b), low, high)), None, (Side([], []), Side([], []))), None
        leaf, low = bound, high


# ---------------------------------------------------------------- Spark jobs

ENCODED = ("kind int, key long, n_a long, n_b long, n_groups long, n_links long, digest string, at long, start long, text binary, "
           "chunk long, keys array<long>, pairs array<long>, times array<long>, spread binary")
TREE = "kind int, key long, at long, first long, ok boolean, " + ", ".join(f"{w}_{s} binary" for w in ("prefix", "suffix") for s in "ab")


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


class Chunks:
    """Gathers parts until a chunk is full."""

    def __init__(self, tokenizers: Tokenizers, label: int):
        self.tokenizers, self.rows, self.size = tokenizers, [], 0
        self.next = (label << 40) + (TaskContext.get().partitionId() << 20)

    def add(self, row: dict, sides: tuple[Side, Side]) -> bool:
        """Whether the chunk is full."""
        self.rows.append((row, sides))
        self.size += int(sides[0][1].sum())
        return self.size >= CHUNK_BYTES or len(self.rows) >= CHUNK_ROWS

    def close(self) -> tuple[list[dict], list[bytes], dict] | None:
        if not self.rows:
            return None
        rows, sides = map(list, zip(*self.rows))
        found = align(sides, self.tokenizers)
        for row, (a, b), n_groups, n_links in zip(rows, sides, found.groups.tolist(), found.links.tolist()):
            row |= {"n_a": len(a[0]), "n_b": len(b[0]), "n_groups": n_groups, "n_links": n_links}
        chunk = {"kind": CHUNK, "chunk": self.next, "keys": [r["key"] for r in rows], "pairs": found.pairs, "times": found.times, "spread": found.spread}
        self.rows, self.size, self.next = [], 0, self.next + 1
        pa.default_memory_pool().release_unused()
        return rows, found.texts, chunk


def _read(files, schema: pa.Schema):
    """Short documents aligned, long ones as pieces; one row per input row, and one per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(*files.value)
        chunks, key = Chunks(tokenizers, 0), TaskContext.get().partitionId() << 33
        waiting: list[dict] = []
        held = 0

        def closed() -> list[dict]:
            done = chunks.close()
            if done:
                for row, text in zip(done[0], done[1]):
                    row["digest"] = hashlib.sha256(text[:-1]).hexdigest()
            rows = [*waiting, *(done[0] if done else []), *([done[2]] if done else [])]
            waiting.clear()
            return rows

        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1).cast(pa.binary())
            for low, high in _slices(texts):
                part = [b" " + (t or b"") for t in texts.slice(low, high - low).to_pylist()]
                short = [i for i, d in enumerate(part) if 1 < len(d) and (len(d) <= LONG_BYTES or not tokenizers.cuts)]
                sides = dict(zip(short, tokenizers.encode([part[i] for i in short])))
                for i, text in enumerate(part):
                    row = {"kind": DOCUMENT, "key": key + low + i, "id": ids[low + i].as_py()}
                    if sides.get(i):
                        if chunks.add(row, sides[i]):
                            yield _rows(schema, closed())
                        continue
                    waiting.append(row | {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "digest": ""})
                    if i in sides or len(text) == 1:
                        continue
                    start = 0
                    for piece in cut_text(text, LONG_BYTES):
                        waiting.append({"kind": PIECE, "key": key + low + i, "start": start, "text": piece})
                        start += len(piece)
                    held += len(text)
                if held >= CHUNK_BYTES or len(waiting) >= CHUNK_ROWS:
                    yield _rows(schema, waiting)
                    waiting.clear()
                    held = 0
            key += batch.num_rows
        if rows := closed():
            yield _rows(schema, rows)
    return run


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES."""
    low = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        size += n
        if size >= SLICE_BYTES:
            yield low, i + 1
            low, size = i + 1, 0
    if low < len(texts):
        yield low, len(texts)


def _tree_row(key: int, at: int, fragment: Fragment | None, sides: tuple[Side, Side] | None = None, ok: bool = True) -> dict:
    """A fragment, or closed groups with their place among the document's."""
    if fragment is None:
        return {"kind": GROUPS, "key": key, "at": at, "ok": ok, "prefix_a": sides[0].packed(), "prefix_b": sides[1].packed()}
    (pa_, pb), (sa, sb) = fragment.prefix, fragment.suffix
    return {"kind": FRAGMENT, "key": key, "at": at, "first": fragment.first, "ok": ok, "prefix_a": pa_.packed(), "prefix_b": pb.packed(),
            "suffix_a": sa.packed(), "suffix_b": sb.packed()}


def _leaves(files, size: int, schema: pa.Schema):
    """The fragments of pieces, named by the byte where they begin; what closes at a leaf's first common end goes before what closes inside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(*files.value)
        for batch in batches:
            for i in range(batch.num_rows):
                key, start, text = (c[i].as_py() for c in batch.columns)
                found = tokenizers.encode([text])[0]
                if found is None:
                    empty = (Side([], []), Side([], []))
                    yield _rows(schema, [_tree_row(key, start, Fragment(empty, None, empty), ok=False)])
                    continue
                rows = []
                for at, fragment, groups in fragments(*found, start, size):
                    rows.append(_tree_row(key, at, fragment))
                    if groups:
                        rows.append(_tree_row(key, 2 * at + 1, None, groups))
                yield _rows(schema, rows)
    return run


def _composed(schema: pa.Schema):
    """One fragment for the neighbours of a group, and the groups that close between them."""
    def run(table: pa.Table) -> pa.Table:
        rows, key = [], table["key"][0].as_py()
        made: Fragment | None = None
        for r in table.sort_by("at").to_pylist():
            sides = [tuple(Side.of(r[f"{w}_{s}"]) for s in "ab") for w in ("prefix", "suffix")]
            own = Fragment(sides[0], r["first"], sides[1])
            if made is None:
                made, at, ok = own, r["at"], r["ok"]
                continue
            made, closed = compose(made, own)
            ok &= r["ok"]
            if closed:
                rows.append(_tree_row(key, 2 * closed[0], None, closed[1]))
        return pa.Table.from_batches([_rows(schema, [*rows, _tree_row(key, at, made, ok=ok)])])
    return run


def _packed(files, schema: pa.Schema):
    """Closed groups of long documents as chunks, with their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(_tokenizers(*files.value), 1)

        def closed() -> Iterator[pa.RecordBatch]:
            if done := chunks.close():
                rows, texts, chunk = done
                yield _rows(schema, [*({**r, "text": t} for r, t in zip(rows, texts)), chunk])

        for batch in batches:
            for i in range(batch.num_rows):
                key, at, a, b = (c[i].as_py() for c in batch.columns)
                if chunks.add({"kind": DOCUMENT, "key": key, "at": at}, (Side.of(a), Side.of(b))):
                    yield from closed()
        yield from closed()
    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest) of texts that come in order of key and place, without the last separator."""
    key, digest, held = None, None, b""
    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if number != key:
                if key is not None:
                    digest.update(held[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "digest"])
                key, digest, held = number, hashlib.sha256(), b""
            digest.update(held)
            held = text.as_py()
    if key is not None:
        digest.update(held[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "digest"])


def _summed(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """Per part of a chunk: links of a best pair, and the sum of counts over its links."""
    keys = chunk["keys"][0].values.to_numpy()
    pair, part, times = spread_out(chunk["spread"][0].as_py())
    count, best = (np.empty(answers.num_rows, np.int64) for _ in range(2))
    place = answers["place"].to_numpy()
    count[place], best[place] = answers["n"].to_numpy(), answers["best"].to_numpy()
    sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
    for total, value in zip(sums, (best, count)):
        np.add.at(total, part, times * value[pair])
    return pa.table({"key": keys, "n_best": sums[0], "count_sum": sums[1]})


def _reduced(leaves: DataFrame, schema: pa.Schema) -> tuple[DataFrame, DataFrame]:
    """(closed groups, one row per document that tells whether all of it is covered)."""
    groups = leaves.where(F.col("kind") == GROUPS).select("key", "at", "prefix_a", "prefix_b")
    current = leaves.where(F.col("kind") == FRAGMENT)
    order = current.select("key", "at").groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("all"))
    current = current.join(order.select("key", F.posexplode("all").alias("n", "at")), ["key", "at"])
    most = current.agg(F.max("n")).first()[0] or 0
    while most:
        made = settle(current.withColumn("n", F.expr(f"n div {FAN_IN}")).groupBy("key", "n").applyInArrow(
            _numbered(_composed(schema)), TREE + ", n long"), "tree")
        groups = groups.union(made.where(F.col("kind") == GROUPS).select("key", "at", "prefix_a", "prefix_b"))
        current = made.where(F.col("kind") == FRAGMENT)
        most //= FAN_IN
    # The text begins where both sides begin, so a whole document's open prefix is a group too.
    groups = groups.union(current.where("first is not null").select("key", (F.col("first") * 2).alias("at"), "prefix_a", "prefix_b"))
    return groups, current.select("key", "ok")


def _numbered(compose_group):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = compose_group(table)
        return made.append_column("n", pa.array([key[1].as_py()] * made.num_rows, pa.int64()))
    return run


def align_tokenizers(docs: DataFrame, vocabulary: bytes, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                     fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocabulary`` and ``model`` are the bytes of the tokenizers' files. A link
    is a pair of tokens of A and B that overlap; ``count_sum`` sums over the
    row's links how many links of the whole table have the same two ids, and
    ``n_best`` counts those whose count no other pair with the same id of B
    exceeds. ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``, the ids by groups.
    Null and empty texts, and texts that one side does not give back byte for
    byte, have no tokens: zeros, and '' for the digest. Repeated rows are aligned
    and counted each; an empty table gives an empty result. Only the two named
    columns are read. Neither the length of a text nor ``fragment_bytes``
    changes a result.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((vocabulary, model))
    many = len(parse(model).pieces)
    read = docs.select(F.col(quote(id_col)).alias("id"), F.col(quote(text_col)).alias("text"))
    typed = T._parse_datatype_string(ENCODED).add("id", read.schema["id"].dataType)
    encoded = settle(read.mapInArrow(_read(files, to_arrow_schema(typed)), typed), "encoded")

    pieces = encoded.where(F.col("kind") == PIECE).select("key", "start", "text").repartition(F.col("key"), F.col("start"))
    tree = to_arrow_schema(T._parse_datatype_string(TREE))
    groups, roots = _reduced(settle(pieces.mapInArrow(_leaves(files, fragment_bytes, tree), TREE), "leaves"), tree)
    whole = groups.join(roots.where("ok").select("key"), "key", "left_semi")
    parts = settle(whole.repartition(F.col("key"), F.col("at")).mapInArrow(
        _packed(files, to_arrow_schema(T._parse_datatype_string(ENCODED))), ENCODED), "parts")
    of_parts = parts.where(F.col("kind") == DOCUMENT)
    digests = of_parts.select("key", "at", "text").repartition("key").sortWithinPartitions("key", "at").select("key", "text").mapInArrow(
        _digests, "key long, digest string")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    long = of_parts.groupBy("key").agg(*[F.sum(n).alias(f"long_{n}") for n in numbers]).join(
        digests.withColumnRenamed("digest", "long_digest"), "key")

    chunks = encoded.where(F.col("kind") == CHUNK).select("chunk", "keys", "pairs", "times", "spread").union(
        parts.where(F.col("kind") == CHUNK).select("chunk", "keys", "pairs", "times", "spread"))
    counts = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(
        F.sum("p.times").alias("n"))
    counts = settle(counts.withColumn("b", F.col("pair") % many), "counts")
    # One row per id of B.
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("highest")))
    answers = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    asked = chunks.select(F.col("chunk").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    replies = asked.join(answers, "pair").select("asker", "place", "n", "best")
    sums = chunks.select("chunk", "keys", "spread").groupBy("chunk").cogroup(replies.groupBy("asker")).applyInArrow(
        _summed, "key long, n_best long, count_sum long").groupBy("key").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))

    rows = encoded.where(F.col("kind") == DOCUMENT).select("key", "id", *numbers, "digest")
    return rows.join(long, "key", "left").join(sums, "key", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"long_{n}", n).alias(n) for n in numbers],
        *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("n_best", "count_sum")],
        F.coalesce("long_digest", "digest").alias("groups_sha256"))
