"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protobuf; its pieces (text, score, type), normaliser and
trainer settings are read from the wire format. From them a tokenizer is rebuilt:
the normaliser and white-space marker, the vocabulary with merges ranked by score
(or, for a unigram model, the scores themselves), byte fallback, and the decoder
that undoes them. Executors get the model's bytes by broadcast and encode each
batch of texts with several threads.

Parity with the reference implementation of the format is verified where asked:
on every row of the table, in the tests on many odd texts.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SLICE_BYTES = 1 << 20

# Fixed values of the model format: piece types, and the trainer's model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    collapse_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size
        elif wire == 2:
            size = varint()
            yield key >> 3, data[at:at + size]
            at += size
        else:
            raise ValueError(f"wire type {wire} is not part of the model format")


def parse(data: bytes) -> Model:
    """Read a model file's bytes."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            settings = dict(_fields(value))
            model.kind = settings.get(3, UNIGRAM)
            model.byte_fallback = bool(settings.get(35, 0))
        elif number == 3:
            settings = dict(_fields(value))
            model.charsmap = settings.get(2, b"")
            model.dummy_prefix = bool(settings.get(3, 1))
            model.collapse_spaces = bool(settings.get(4, 1))
            model.escape_spaces = bool(settings.get(5, 1))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if not model.escape_spaces:
        raise ValueError("models that do not mark white space are not supported")
    return model


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, best score of the result first."""
    usable = {p: s for p, s, kind in pieces if kind in (NORMAL, USER_DEFINED)}
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = [(-score, ids[p], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, score in usable.items()
             for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """A tokenizer of the tokenizers library with the same behaviour; control pieces are never produced from text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab=vocabulary, merges=_merges(model.pieces), byte_fallback=model.byte_fallback, fuse_unk=True,
                          unk_token=None if unknown is None else model.pieces[unknown][0])
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    return tokenizer


@lru_cache(maxsize=4)
def _built(data: bytes, threads: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    return build(parse(data))


@lru_cache(maxsize=4)
def _reference(data: bytes):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def _piece_bytes(model: Model) -> list[bytes]:
    """What each piece adds to a text; joined, these are the text behind its dummy prefix."""
    return [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= SLICE_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", threads: int = 2,
           verify_every: int = 1, place: Column | None = None) -> DataFrame:
    """One row per input row: id, token_ids, n_tokens, n_byte_tokens, n_unknown, round_trip, parity, and ``place`` if it is given.

    ``round_trip`` tells whether the pieces' bytes give the text back, as decoding
    them does; they do unless the normaliser changes the text or a character has
    no piece.
    ``parity`` compares the ids with the reference implementation's, on every
    ``verify_every``-th row of a batch (0: none; null where not compared). Null
    text counts as empty and has no tokens. Texts are encoded whole. Repeated
    rows are encoded row by row; an empty table gives an empty result. Only the
    two named columns are read, and what ``place`` needs.
    """
    read = docs.select(F.col(id_col), F.col(text_col), *([] if place is None else [place.alias("place")]))
    share = docs.sparkSession.sparkContext.broadcast(model)
    parsed = parse(model)
    kinds = np.array([kind for _, _, kind in parsed.pieces], np.int8)
    parts, prefix = _piece_bytes(parsed), b" " if parsed.dummy_prefix else b""
    schema = T.StructType([
        read.schema[0], T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_byte_tokens", "n_unknown")],
        T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType()), *read.schema[2:]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _built(share.value, threads)
        reference = _reference(share.value) if verify_every else None
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for low, high in _slices(texts):
                part = texts[low:high]
                ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                same = [b"".join(map(parts.__getitem__, i)) == (prefix if t else b"") + t.encode() for i, t in zip(ids, part)]
                parity: list[bool | None] = [None] * len(part)
                if reference is not None:
                    picked = range(0, len(part), verify_every)
                    for i, other in zip(picked, reference.encode([part[i] for i in picked], num_threads=1)):
                        parity[i] = other == ids[i]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if ends[-1] else np.empty(0, np.int32)
                kind = kinds[flat]
                per = [np.add.reduceat(np.append(kind == k, False).astype(np.int64), ends[:-1]) * (np.diff(ends) > 0) for k in (BYTE, UNKNOWN)]
                columns = [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                           pa.array(np.diff(ends).astype(np.int64)), *[pa.array(p) for p in per], pa.array(same), pa.array(parity, pa.bool_()),
                           *[c.slice(low, high - low) for c in batch.columns[2:]]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return read.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "token_ids", threads: int = 2) -> DataFrame:
    """One row per input row: id and ``text`` of its token ids; null ids count as none, an id outside the model is an error."""
    share = tokens.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([tokens.select(F.col(id_col)).schema[0], T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _built(share.value, threads)
        size = tokenizer.get_vocab_size()
        for batch in batches:
            ids = [i or [] for i in batch.column(1).to_pylist()]
            if any(not 0 <= x < size for i in ids for x in i):
                raise ValueError("a token id lies outside the model")
            texts = tokenizer.decode_batch(ids, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), pa.array(texts, pa.string())], schema=arrow)

    return tokens.select(F.col(id_col), F.col(ids_col).cast("array<int>")).mapInArrow(run, schema)
