"""Edit-aware token counts.

A text is cut into pre-tokens by the tokenizer's expression; tokens never cross
them. Blocks of pre-tokens are the leaves of a segment tree that holds, per
subtree, characters and tokens. An edit goes down the tree to the first pre-token
that it can influence, cuts and counts again from there until a new boundary
meets an old one, replaces the leaves it touched and updates the sums above them.
What lies outside keeps its counts: the expression looks ahead by one character
at most beyond what it takes and never behind, so equal text from an equal
boundary is cut alike.

Documents are independent rows: Spark deals them out, and each is counted by one
small tree in the task that reads it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token expression of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 64
CACHED_PIECES = 100_000
# A pre-token is settled by its characters and at most two more: the one that ends it and the one it looks ahead to.
CONTEXT = 2

EDITS = "array<struct<at:int,removed:int,inserted:string>>"


class Counter:
    """Tokens per pre-token, with a bounded cache."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, pieces: Sequence[str]) -> list[int]:
        known = self.known
        found = [known.get(p) for p in pieces]
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    if (n := known.get(pieces[i])) is None:
                        n = len(self.encoding.encode_ordinary(pieces[i]))
                        if len(pieces[i]) < 64:
                            if len(known) >= CACHED_PIECES:
                                known.clear()
                            known[pieces[i]] = n
                    found[i] = n
        return found


class CountTree:
    """Characters and tokens of one text, by blocks of pre-tokens under a segment tree."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.text, self.recounted = counter, text, 0
        pieces = counter.pattern.findall(text)
        self._fill(list(map(len, pieces)), counter.count(pieces))

    def _fill(self, lengths: list[int], counts: list[int]) -> None:
        self.blocks = [(lengths[i:i + BLOCK], counts[i:i + BLOCK]) for i in range(0, len(lengths), BLOCK)] or [([], [])]
        self.leaves = 1
        while self.leaves < len(self.blocks):
            self.leaves *= 2
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for i, (ls, cs) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(ls), sum(cs)
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _block_at(self, place: int) -> tuple[int, int]:
        """The block that holds a character, and where it begins; the last block for the end of the text."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            # Beyond the last used leaf there are no characters to go to.
            if place >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def _set(self, block: int, lengths: list[int], counts: list[int]) -> None:
        self.blocks[block] = (lengths, counts)
        node = self.leaves + block
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters at ``at``; both are cut to the text's bounds."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        new = self.text[:at] + inserted + self.text[at + removed:]
        shift, edge = len(inserted) - removed, at + len(inserted)
        first, start = self._block_at(max(0, at - CONTEXT))
        # Pre-tokens of the block that end before the edit's reach stay.
        lengths, counts = self.blocks[first]
        keep = 0
        while keep < len(lengths) and start + lengths[keep] + CONTEXT <= at:
            start += lengths[keep]
            keep += 1
        new_lengths, new_counts = list(lengths[:keep]), list(counts[:keep])
        # Old boundaries are walked along with the new ones, from the same start.
        block, index, old, place, pieces = first, keep, start, start, []
        met = False
        while place < len(new):
            if place >= edge:
                while old < place - shift:
                    while block < len(self.blocks) and index >= len(self.blocks[block][0]):
                        block, index = block + 1, 0
                    old += self.blocks[block][0][index]
                    index += 1
                if old == place - shift and old >= at + removed:
                    met = True
                    break
            piece = self.counter.pattern.match(new, place).group()
            pieces.append(piece)
            place += len(piece)
        new_lengths += map(len, pieces)
        new_counts += self.counter.count(pieces)
        self.recounted += len(pieces)
        self.text = new
        last = min(block, len(self.blocks) - 1) if met else len(self.blocks) - 1
        if met:
            new_lengths += self.blocks[last][0][index:] if last == block else []
            new_counts += self.blocks[last][1][index:] if last == block else []
        if len(new_lengths) > 8 * BLOCK:
            # A large insertion: deal the blocks out anew; no pre-token is counted again.
            before, after = self.blocks[:first], self.blocks[last + 1:]
            self._fill([x for b in before for x in b[0]] + new_lengths + [x for b in after for x in b[0]],
                       [x for b in before for x in b[1]] + new_counts + [x for b in after for x in b[1]])
            return
        self._set(first, new_lengths, new_counts)
        for b in range(first + 1, last + 1):
            self._set(b, [], [])


def load(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _counter(vocabulary: bytes, pattern: str) -> Counter:
    return Counter(vocabulary, pattern)


def edits_of(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``edits`` made of the rows (id, seq, at, removed, inserted) of an edit table, in order of ``seq``.

    The edits of one document meet in its row.
    """
    grouped = edits.groupBy(F.col(id_col).alias("__id")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("__e"))
    joined = docs.join(grouped, F.col(id_col) == F.col("__id"), "left")
    listed = F.transform("__e", lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted")))
    return joined.select(*docs.columns, F.coalesce(listed.cast(EDITS), F.array().cast(EDITS)).alias("edits"))


def count_tokens(docs: DataFrame, vocabulary: bytes, edits: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
                 pattern: str = PATTERN) -> DataFrame:
    """One row per input row: id, n_tokens, n_pieces, n_edits, edited_n_tokens, edited_n_chars, n_recounted.

    ``edits`` is an array of (at, removed, inserted), applied in order, each in
    positions of the text that the one before left; positions beyond the text are
    cut to it, and a null array, edit or part of one counts as none, 0 or empty.
    ``n_recounted`` is the number of pre-tokens that all edits had cut again.
    Null text counts as empty. Repeated rows are counted row by row; an empty
    table gives an empty result. Only the named columns are read.
    """
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([docs.select(F.col(id_col)).schema[0], *[T.StructField(c, T.LongType()) for c in (
        "n_tokens", "n_pieces", "n_edits", "edited_n_tokens", "edited_n_chars", "n_recounted")]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(share.value, pattern)
        for batch in batches:
            out = []
            for text, changes in zip(batch.column(1), batch.column(2)):
                tree = CountTree(text.as_py() or "", counter)
                before = (tree.total, sum(len(b[0]) for b in tree.blocks))
                todo = [c for c in changes.as_py() or [] if c]
                for c in todo:
                    tree.edit(c["at"] or 0, c["removed"] or 0, c["inserted"] or "")
                out.append((*before, len(todo), tree.total, len(tree.text), tree.recounted))
            columns = [batch.column(0).cast(arrow[0].type), *[pa.array([o[k] for o in out], pa.int64()) for k in range(6)]]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    listed = F.array().cast(EDITS) if edits is None else edits.cast(EDITS)
    return docs.select(F.col(id_col), F.col(text_col), listed.alias("__edits")).mapInArrow(run, schema)
