"""Token ids of texts by way of their distinct chunks, so that a tokenizer sees each chunk once.

A chunk ends where a single space stands between two characters that aren't white space. No match
of the public byte-level splitting pattern crosses such a place, so the tokens of a text are those
of its chunks in order. Chunks are found and told apart with array operations over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from roadfuse.llm.wordhash import hash_spans, pieces, ragged

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes, and last two bytes, of white space outside ASCII. Other characters share them; that only makes chunks longer.
_FIRST = np.zeros(256, bool)
_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_BUT_LAST, _LAST = np.zeros(256, bool), np.zeros(256, bool)
_BUT_LAST[[0xC2, 0x80, 0x81, 0x9A]] = True
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def chunk_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row, outer) of every chunk; the space before a chunk isn't part of it.

    Outer are the first and the last chunk of a text: there no space comes before, or white space may end it.
    """
    n = len(raw)
    padded = np.concatenate((np.zeros(2, np.uint8), raw, np.zeros(1, np.uint8)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(raw == 32)
    before, back, after = padded[at + 1], padded[at], padded[at + 3]
    good = ~_WHITE[before] & ~_WHITE[after] & ~_FIRST[after] & ~(_BUT_LAST[back] & _LAST[before]) & ~edge[at] & ~edge[at + 1]
    cuts = at[good]
    filled = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate((offsets[:-1][filled], cuts + 1)))
    ends = np.sort(np.concatenate((offsets[1:][filled], cuts)))
    rows = np.searchsorted(offsets, starts, "right") - 1
    change = rows[1:] != rows[:-1]
    outer = np.concatenate(([True], change)) | np.concatenate((change, [True])) if len(rows) else np.zeros(0, bool)
    return starts, ends, rows, outer


#: Chunks that the tokenizer sees in one text.
_JOINED = 4_000


class ChunkEncoder:
    """``encode(texts, ends)`` gives the (ids, number of ids per chunk) of UTF-8 texts; chunks end at ``ends``, counted over all texts.

    Chunks that were met stay known, as hashes, until there are ``most``; then all are forgotten.
    That bounds memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 800_000):
        self._encode, self._most = encode, most
        self._reset()

    def _reset(self) -> None:
        self._hash = np.zeros(0, _U)
        self._starts, self._lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self._store, self._used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        first, self._used = self._used, self._used + len(ids)
        if self._used > len(self._store):
            self._store = np.concatenate((self._store, np.zeros(self._used, np.int32)))
        self._store[first : self._used] = ids
        return first

    def _find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, number) in the store of the ids of each inner chunk."""
        h, where, back = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self._hash, h)
        new = at == len(self._hash)
        new[~new] = self._hash[at[~new]] != h[~new]
        if new.any():
            own = where[new]
            lengths = ends[own] - starts[own] + 1
            joined, upto = raw[ragged(starts[own] - 1, lengths)].tobytes(), np.cumsum(lengths)
            cuts = [0, *upto[_JOINED - 1 :: _JOINED].tolist()]
            cuts += [len(joined)] if cuts[-1] < len(joined) else []
            ids, counts = self._encode([joined[a:b] for a, b in zip(cuts, cuts[1:])], upto)
            first = self._keep(ids) + np.cumsum(counts) - counts
            both = np.concatenate((self._hash, h[new]))
            order = np.argsort(both, kind="stable")
            self._hash = both[order]
            self._starts = np.concatenate((self._starts, first))[order]
            self._lengths = np.concatenate((self._lengths, counts.astype(np.int32)))[order]
            at = np.searchsorted(self._hash, h)
        return self._starts[at][back], self._lengths[at][back].astype(np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); ``offsets`` start at 0."""
        if len(self._hash) > self._most:
            self._reset()
        starts, ends, rows, outer = chunk_spans(raw, offsets)
        first, lengths = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        inner = np.flatnonzero(~outer)
        if len(inner):
            first[inner], lengths[inner] = self._find(raw, starts[inner], ends[inner])
        mark = self._used
        alone = np.flatnonzero(outer)
        if len(alone):
            spaced = starts[alone] - (starts[alone] > offsets[rows[alone]])
            texts = [raw[a:b].tobytes() for a, b in zip(spaced.tolist(), ends[alone].tolist())]
            ids, counts = self._encode(texts, np.cumsum(ends[alone] - spaced))
            first[alone] = self._keep(ids) + np.cumsum(counts) - counts
            lengths[alone] = counts
        flat = self._store[ragged(first, lengths)]
        self._used = mark
        total = np.zeros(len(offsets) - 1, np.int64)
        np.add.at(total, rows, lengths)
        return flat, total


def encoded(encoder: ChunkEncoder, raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, number of ids per row) for runs of about ``size`` bytes."""
    for a, b in pieces(raw, offsets, size):
        yield a, b, *encoder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
