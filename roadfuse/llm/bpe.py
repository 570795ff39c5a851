"""Byte-level BPE from a file of ranks, by replaying merges over a corpus slice.

Each task cuts its documents into slices. The distinct pre-tokens of a slice stand in one array
of symbols, linked to their neighbours inside a word; an inverted index leads from each pair's
rank to the positions where the pair stands. Ranks leave a heap in ascending order, a rank is
applied to all its positions at once, and only the two neighbours of a merged position are looked
up again and enter the index. In one word only the first position of a rank is merged at a time,
because its neighbours may form a pair of a lower rank, which then comes first.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.chunks import ChunkEncoder, encoded
from roadfuse.llm.shared import freed, remembered
from roadfuse.llm.wordhash import hash_spans, ragged, strings

#: Bytes of text that share one slice.
SLICE_BYTES = 2_500_000
_NONE = np.int32(2**31 - 1)


def _read(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Ranks:
    """Ranks of a file's tokens, and the rank of each pair of tokens that a merge can join."""

    def __init__(self, path: str):
        self.rank = _read(path)
        pairs = [
            (left * 2**32 + right, rank)
            for token, rank in self.rank.items()
            for cut in range(1, len(token))
            if (left := self.rank.get(token[:cut])) is not None and (right := self.rank.get(token[cut:])) is not None
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.ranks = np.array([r for _, r in pairs], np.int32)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)

    def of_pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where the two tokens don't merge."""
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of ids of each); no word is empty."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbol = ranks.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    n = len(symbol)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    firsts = np.cumsum(lengths) - lengths
    after[firsts + lengths - 1] = -1
    before[firsts] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, _NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank[inner] = ranks.of_pair(symbol[inner], symbol[inner + 1])
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def enter(positions: np.ndarray) -> None:
        own = rank[positions]
        positions, own = positions[own != _NONE], own[own != _NONE]
        order = np.argsort(own, kind="stable")
        positions, own = positions[order], own[order]
        cuts = np.flatnonzero(np.diff(own)) + 1
        for part, r in zip(np.split(positions, cuts), own[np.concatenate(([0], cuts))].tolist() if len(own) else ()):
            if r not in index:
                heapq.heappush(heap, r)
            index[r].append(part)

    enter(inner)
    while heap:
        r = heapq.heappop(heap)
        found = index.pop(r)
        positions = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        positions = positions[rank[positions] == r]
        if len(positions) > 1:
            own = word[positions]
            first = np.concatenate(([True], own[1:] != own[:-1]))
            if not first.all():
                index[r].append(positions[~first])
                heapq.heappush(heap, r)
                positions = positions[first]
        if not len(positions):
            continue
        gone = after[positions]
        symbol[positions] = r
        alive[gone] = False
        rank[gone] = _NONE
        right = after[gone]
        after[positions] = right
        has = right >= 0
        before[right[has]] = positions[has]
        rank[positions] = _NONE
        rank[positions[has]] = ranks.of_pair(symbol[positions[has]], symbol[right[has]])
        left = before[positions]
        has_left = left >= 0
        left = left[has_left]
        rank[left] = ranks.of_pair(symbol[left], symbol[positions[has_left]])
        enter(np.concatenate((left, positions[has])))
    return symbol[alive], np.bincount(word[alive], minlength=len(words)).astype(np.int64)


def _chunk_ids(ranks: Ranks, pattern: str):
    find = regex.compile(pattern).findall

    def encode(texts: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        matches = [match for text in texts for match in find(text.decode())]
        characters = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        upto = byte_of[characters]
        since = np.concatenate(([0], upto[:-1]))
        _, where, back = np.unique(hash_spans(raw, since, upto), return_index=True, return_inverse=True)
        words = [joined[a:b] for a, b in zip(since[where].tolist(), upto[where].tolist())]
        whole = np.fromiter((ranks.rank.get(word, -1) for word in words), np.int32, len(words))
        cut = np.flatnonzero(whole < 0)
        ids, own = replay([words[i] for i in cut], ranks) if len(cut) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        lengths = np.ones(len(words), np.int64)
        lengths[cut] = own
        starts = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.int32)
        flat[starts] = whole
        flat[ragged(starts[cut], own)] = ids
        upto_ids = np.concatenate(([0], np.cumsum(lengths[back])))
        counts = np.diff(upto_ids[np.searchsorted(upto, ends) + 1], prepend=0)
        return flat[ragged(starts[back], lengths[back])], counts

    return encode


def _encoder(path: str, pattern: str) -> ChunkEncoder:
    """One per Python worker; the chunks it knows serve later tasks of the worker too."""
    return remembered(("bpe", path, pattern), lambda: ChunkEncoder(_chunk_ids(Ranks(path), pattern)))


def _with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids`` array<int>: the tokens of ``text``, without special tokens.

    ``path`` is the rank file, present on every executor. A null text counts as empty and gives an
    empty array. A column of the name ``ids`` is replaced. Rows keep their number and order.
    """
    docs = docs.drop(ids)
    return docs.mapInArrow(freed(_encoding(path, pattern, text, ids)), docs.select("*", F.lit(None).cast("array<int>").alias(ids)).schema)


def _encoding(path: str, pattern: str, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            for a, b, flat, counts in encoded(encoder, *strings(batch.column(batch.schema.get_field_index(text))), SLICE_BYTES):
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield _with_column(batch.slice(a, b - a), ids, pa.ListArray.from_arrays(bounds, flat))

    return run


def _letters(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per rank its number of bytes (-1: no such token) and their start in the third array."""
    by_rank = sorted((rank, token) for token, rank in _read(path).items())
    lengths = np.full(by_rank[-1][0] + 1 if by_rank else 0, -1, np.int64)
    lengths[[rank for rank, _ in by_rank]] = [len(token) for _, token in by_rank]
    own = np.maximum(lengths, 0)
    return lengths, np.cumsum(own) - own, np.frombuffer(b"".join(token for _, token in by_rank), np.uint8)


def decode(tokens: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``data`` binary: the bytes of the array<int> column ``ids``.

    A null array gives null; an id without a token is an error. A column of the name ``data`` is replaced.
    """
    tokens = tokens.drop(data)
    return tokens.mapInArrow(freed(_decoding(path, ids, data)), tokens.select("*", F.lit(None).cast("binary").alias(data)).schema)


def _decoding(path: str, ids: str, data: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts, letters = remembered(("tokens of ranks", path), lambda: _letters(path))
        for batch in batches:
            out = []
            for row in batch.column(batch.schema.get_field_index(ids)):
                if not row.is_valid:
                    out.append(None)
                    continue
                own = row.values.to_numpy(zero_copy_only=False)
                if len(own) and (own.min() < 0 or own.max() >= len(lengths) or lengths[own].min() < 0):
                    raise ValueError("an id has no token in this vocabulary")
                out.append(letters[ragged(starts[own], lengths[own])].tobytes())
            yield _with_column(batch, data, pa.array(out, pa.binary()))

    return run


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``decode(encode(docs))`` without the text, in one Python worker a task instead of two; the bytes come from the ids alone."""
    others = docs.drop(ids, data).drop(text)
    schema = others.select("*", F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("binary").alias(data)).schema
    encode_run, decode_run = _encoding(path, pattern, text, ids), _decoding(path, ids, data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decode_run(batch.drop_columns([text]) for batch in encode_run(batches))

    return docs.drop(ids, data).mapInArrow(freed(run), schema)


def digests(tokens: DataFrame, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256."""
    return tokens.withColumns(
        {
            "n_tokens": F.size(ids).cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256),
            "decoded_sha256": F.sha2(data, 256),
        }
    )
