"""Words and shingles of whole Arrow batches as 64-bit hashes, without a loop over words.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r; A-Z count as a-z where asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)
_WEIGHTS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 | 1 for k in range(1, 65)], object)
_WEIGHTS = np.array([int(w) % 2**64 for w in _WEIGHTS], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def pieces(raw: np.ndarray, offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, min(end, n)
        row = end


def word_spans(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row) of every word; ``offsets`` start at 0, ``outside`` marks bytes of no word."""
    letter = ~outside[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], letter))[: len(raw)]
    starts = np.flatnonzero(letter & (~before | edge[: len(raw)]))
    after = np.concatenate((letter[1:], [False])) if len(raw) else letter
    ends = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, eight bytes at a time."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(_U) * _WEIGHTS[7])
    live, at = np.arange(len(starts)), starts.copy()
    while len(live):
        left = ends[live] - at
        chunk = eight[at] & _KEEP[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ chunk) * _WEIGHTS[3] + _WEIGHTS[5])
        more = left > 8
        live, at = live[more], at[more] + 8
    return h


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word in order."""
    if lower:
        raw = _LOWER[raw]
    starts, ends, rows = word_spans(raw, offsets)
    return hash_spans(raw, starts, ends), rows


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, _U)
    total = np.zeros(len(h) - k + 1, _U)
    for j in range(k):
        total += h[j : len(h) - k + 1 + j] * _WEIGHTS[8 + j]
    return mix(total)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes; fewer than ``k`` words make one shingle, none make none."""
    raw, offsets = strings(column)
    for first, end in pieces(raw, offsets):
        own = offsets[first : end + 1] - offsets[first]
        h, rows = word_hashes(raw[offsets[first] : offsets[end]], own)
        bounds = np.searchsorted(rows, np.arange(end - first + 1))
        grams = shingles(h, k)
        for i in range(end - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                short = (h[a:b] * _WEIGHTS[24 : 24 + b - a]).sum(dtype=_U, keepdims=True)
                yield mix(short + _WEIGHTS[40 + b - a])
            else:
                yield np.zeros(0, _U)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
