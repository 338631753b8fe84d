"""Word shingles of whole texts as sorted 64-bit hashes, computed on byte arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text with A-Z
lower-cased; no multi-byte character contains such a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from barloom.llm.common import scrambled

PIECE_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = scrambled(np.arange(1, 257, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _STEP | np.uint64(1), np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _hash_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of concatenated texts that begin at ``edges``, and the text number of each word."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inside = edges[(edges > 0) & (edges < len(data))]
    begins[inside] = ~space[inside]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = np.flatnonzero(~space)
    first = np.searchsorted(solid, starts)
    lengths = np.diff(np.append(first, len(solid)))
    place = np.arange(len(solid)) - np.repeat(first, lengths)
    sums = np.add.reduceat(_CODE[_FOLD[data[solid]]] * _powers(int(lengths.max()))[place], first)
    return scrambled(sums + lengths.astype(np.uint64)), np.searchsorted(edges, starts, side="right") - 1


def _batches(texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Runs of texts of about PIECE_BYTES in all: their numbers, bytes and beginnings. A longer text is cut at white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        low, high = int(offsets[at]), int(offsets[end])
        if high - low <= 2 * PIECE_BYTES:
            yield list(range(at, end)), data[low:high], offsets[at:end].astype(np.int64) - low
        else:
            while low < high:
                cut = min(low + PIECE_BYTES, high)
                while cut < high and not _SPACE[data[cut]]:
                    cut += 1
                yield [at], data[low:cut], np.zeros(1, np.int64)
                low = cut
        at = end


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, hashes of its words in order) for every text; null counts as empty."""
    held: list[np.ndarray] = []
    number = -1
    for numbers, data, edges in _batches(texts):
        hashes, owner = _hash_words(data, edges)
        bounds = np.searchsorted(owner, np.arange(len(numbers) + 1))
        for k, n in enumerate(numbers):
            if n != number:
                if number >= 0:
                    yield number, held[0] if len(held) == 1 else np.concatenate(held)
                held, number = [], n
            held.append(hashes[bounds[k]:bounds[k + 1]])
    if number >= 0:
        yield number, held[0] if len(held) == 1 else np.concatenate(held)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of ``width`` words; the whole sequence if shorter; nothing without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    last = len(words) - width + 1
    total = np.full(last, np.uint64(width), np.uint64)
    for k, odd in enumerate(_powers(width + 1)[1:]):
        total += words[k:k + last] * odd
    total = np.sort(scrambled(total))
    new = np.empty(last, bool)
    new[0] = True
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]
