"""Words and word shingles of whole texts as 64-bit hashes, computed with numpy
over the bytes of an Arrow batch.

A word is a maximal run of characters other than space and the controls 9-13;
A-Z are lower-cased first. UTF-8 keeps these bytes apart from any other
character, so bytes and code points give the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def series(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed)) * _U(0x9E3779B97F4A7C15)) | _U(1)


BYTE_CODE = series(256, 1000)
BYTE_CODE[SPACE] = 0
LAG_CODE = series(64, 5000)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array and, per row, the index of its first word.

    The second array has one entry more than there are rows. NULL counts as ''.
    """
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    if not n or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    bounds = offsets - offsets[0]
    packed = data.tobytes()
    if lower:
        packed = packed.translate(LOWER.tobytes())
        data = np.frombuffer(packed, np.uint8)
    gap = np.frombuffer(packed.translate(SPACE.tobytes()), bool)
    begin = ~gap
    begin[1:] &= gap[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begin[edge] = ~gap[edge]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = np.diff(np.r_[starts, len(data)])
    place = np.arange(starts[0], len(data), dtype=np.int64) - np.repeat(starts, lengths)
    place_code = series(int(lengths.max()), 9000)
    with np.errstate(over="ignore"):
        value = place_code.take(place)
        value *= BYTE_CODE.take(data[starts[0]:])
        # a word ends at the next space or row end: bytes of spaces add nothing, and a row's end starts a new word
        return mix(np.add.reduceat(value, starts - starts[0])), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words starting at each word (of one text)."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = words[:n] * LAG_CODE[0]
        for j in range(1, size):
            total = total + words[j:j + n] * LAG_CODE[j]
        return mix(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer words, the whole sequence as one."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(size, len(words))))


def row_shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows of ``word_hashes``, not yet distinct, and where each row's begin; a row with fewer words
    has its whole sequence as one."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    start = np.r_[0, np.cumsum(n)]
    hashes = shingle_hashes(words, size)
    row = np.repeat(np.arange(len(n)), n)
    out = hashes[np.minimum(np.arange(start[-1]) - start[row] + first[row], max(len(hashes) - 1, 0))] if len(hashes) else (
        np.zeros(start[-1], np.uint64))
    for r in np.flatnonzero((count > 0) & (count < size)):
        out[start[r]] = shingle_hashes(words[first[r]:first[r + 1]], int(count[r]))[0]
    return out, start


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of all rows of ``word_hashes``, one after the other, and where each row's begin."""
    out, start = row_shingles(words, first, size)
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[start[:-1][start[:-1] < len(out)]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][start]
