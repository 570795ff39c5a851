"""Benchmark passages in documents, up to a budget of edits, by q-gram counting and banded alignment.

Texts are compared as lower-cased letters and digits with single spaces between. A passage of m
characters with at most e edits keeps (m - q + 1) - e * q of its q-grams (the q-gram lemma), all on
diagonals (place in the document minus place in the passage) at most e apart. Diagonals are cut
into bands of width 2e that overlap by e, so one band holds them all. Bands with enough distinct
q-grams are touching bands put together and aligned, and an alignment within the budget is a match.

A q-gram that stands in a passage more than ``REPEATS`` times would meet each of its places in a text
with each of these. It is taken as kept without a look, and as many fewer others are asked for. A
passage made mostly of such q-grams is sought by places of the text alone: a match is at most
m + e characters long, so regions with enough places of the passage's q-grams within that reach are
aligned as one band. The work grows with the text, not with the product of repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import freed, remembered, written
from roadfuse.llm.wordhash import mix, ragged

#: Characters of a q-gram, and the largest share of a passage's characters that may be edited.
Q, EDITS = 10, 0.08
#: Characters of benchmark text that are looked for in one pass; more text takes more passes.
BLOCK_CHARS = 8_000_000
#: Places in one passage beyond which a q-gram is not placed one by one.
REPEATS = 4
_SLOTS = 24  # bits of the table that sorts out most places of a document at once
_MATCHES = "array<struct<item_id: long, first: long, last: long, edits: int>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())]))


def _folded() -> np.ndarray:
    return np.fromiter((i if chr(i).isalnum() else 32 for i in range(0x110000)), np.uint32, 0x110000)


def normal(text: str | None) -> np.ndarray:
    """Code points: lower case, runs of other characters than letters and digits as one space, none at the ends."""
    points = remembered(("alnum",), _folded)[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = points != 32
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter | np.concatenate(([False], letter[:-1]))
    points = points[keep]
    return points[:-1] if points[-1] == 32 else points


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q consecutive code points."""
    h, width = points.astype(np.uint64), 1
    parts = []  # h of width 1, 2, 4, ... put together to q
    done, total = 0, None
    while done < q:
        if q & width:
            own = h[done : len(points) - q + 1 + done]
            total = own if total is None else total * np.uint64(0xD6E8FEB86659FD93) + own
            done += width
        if done < q:
            h = h[: len(h) - width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:] if len(h) > width else h[:0]
            width *= 2
    return mix(total) if total is not None and len(total) else np.zeros(0, np.uint64)


def budget(m: int, q: int, share: float) -> int:
    """Edits that a passage of m characters may have: the share, but so few that the lemma asks for one q-gram at least; -1 for none."""
    return min(int(m * share), (m - q) // q) if m >= q else -1


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """(edits, end in text) of the best alignment of all of ``passage`` on diagonals low..high, None if over ``most``."""
    width = high - low + 1
    lanes = np.arange(width)
    padded = np.full(len(passage) + width + 1, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    far = 1 << 20
    # row[k]: edits with some passage characters used and the text up to diagonal low + k; the start in the text is free.
    row = np.where((lanes + low >= 0) & (lanes + low <= len(text)), 0, far)
    for r, letter in enumerate(passage):
        step = row + (padded[r : r + width] != letter)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        at = lanes + low + r + 1
        step[(at < 0) | (at > len(text))] = far
        row = np.minimum.accumulate(step - lanes) + lanes
        if row.min() > most:
            return None
    best = int(row.argmin())
    return int(row[best]), best + low + len(passage)


class Passages:
    """The benchmark's q-grams: a table of slots, the sorted hashes, and per hash its items and places."""

    def __init__(self, items: list[tuple[int | None, str | None]], q: int, share: float):
        self.q = q
        points = [(i, normal(t)) for i, t in items]
        points = [(i, p, budget(len(p), q, share)) for i, p in points]
        self.items = [x for x in points if x[2] >= 0]
        self.short = [(i, p) for i, p, e in points if e < 0 and len(p)]
        kept = [self._kept(grams(p, q), len(p) - q + 1 - e * q) for _, p, e in self.items]
        h = np.concatenate([*(k[0] for k in kept), np.zeros(0, np.uint64)])
        place = np.concatenate([*(k[1] for k in kept), np.zeros(0, np.int64)])
        item = np.repeat(np.arange(len(kept)), [len(k[0]) for k in kept])
        order = np.argsort(h, kind="stable")
        self.hashes, first = np.unique(h[order], return_index=True)
        self.first, self.count = first, np.diff(np.append(first, len(h)))
        self.item, self.place = item[order], place[order]
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.hashes >> np.uint64(64 - _SLOTS)] = True
        self.edits = np.array([e for _, _, e in self.items], np.int64)
        self.need = np.array([k[2] for k in kept], np.int64)
        self.loose = np.array([k[3] for k in kept], bool)
        self.longest = max((len(p) + 4 * e for _, p, e in self.items), default=0)

    @staticmethod
    def _kept(own: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
        """(q-grams, their places, how many of them a match keeps, whether places don't count) of one passage."""
        distinct, first, back, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
        repeated = times[back] > REPEATS
        if 2 * repeated.sum() > need:
            return distinct, first, need, True
        return own[~repeated], np.flatnonzero(~repeated), need - int(repeated.sum()), False

    def search(self, text: str | None) -> list[dict]:
        """Matches of the whole text: per item the one with the fewest edits, the first of those."""
        points, best = normal(text), {}
        for start in range(0, max(1, len(points)), 1 << 20):  # long texts piece by piece, overlapping by a passage
            part = points[start : start + (1 << 20) + self.longest]
            for item, first, last, edits in self._part(part):
                own = (edits, start + first, start + last)
                best[item] = min(best.get(item, own), own)
        out = [{"item_id": self.items[k][0], "first": f, "last": t, "edits": e} for k, (e, f, t) in best.items()]
        if self.short:  # fewer characters than a q-gram: as whole words
            whole = np.concatenate(([32], points, [32])).astype(np.uint32).tobytes()
            for item, own in self.short:
                sought, at = np.concatenate(([32], own, [32])).astype(np.uint32).tobytes(), -1
                while (at := whole.find(sought, at + 1)) >= 0 and at % 4:
                    pass
                if at >= 0:
                    out.append({"item_id": item, "first": at // 4, "last": at // 4 + len(own), "edits": 0})
        return sorted(out, key=lambda x: (x["item_id"] is None, x["item_id"], x["first"]))

    def _part(self, points: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = grams(points, self.q) if len(points) >= self.q else np.zeros(0, np.uint64)
        at = np.flatnonzero(self.slots[h >> np.uint64(64 - _SLOTS)])
        if not len(at):
            return
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at]
        at, k = at[same], k[same]
        entry = ragged(self.first[k], self.count[k])
        at = np.repeat(at, self.count[k])
        item, place = self.item[entry], self.place[entry]
        # An item whose q-grams are too few in all needs no bands.
        enough = (np.bincount(item, minlength=len(self.items)) >= self.need)[item]
        at, item, place = at[enough], item[enough], place[enough]
        if not len(at):
            return
        for own, low, high in self._bands(at, item, place):
            passage, e = self.items[own][1], int(self.edits[own])
            found = align(passage, points, low, high, e)
            if found:
                yield own, max(0, found[1] - len(passage)), found[1], found[0]

    def _bands(self, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, lowest diagonal, highest) to align, by shared q-grams at ``at`` in the text and ``place`` in the item; none touch."""
        owners, lows, highs = [], [], []
        loose = self.loose[item]
        if not loose.all():
            own, diagonal, kept = item[~loose], (at - place)[~loose], place[~loose]
            e = self.edits[own]
            step = np.maximum(2 * e, 1)
            for shift in (0, 1):
                # Band b of the first kind holds diagonals from b * 2e on, of the second kind from (2b - 1) * e on.
                band = (diagonal + (e if shift else 0)) // step
                triple = np.unique(np.stack((own, band, kept)), axis=1)
                pair, number = np.unique(triple[:2], axis=1, return_counts=True)
                who, b = pair[:, number >= self.need[pair[0]]]
                margin = self.edits[who]
                start = b * np.maximum(2 * margin, 1) - (margin if shift else 0)
                owners.append(who)
                lows.append(start - margin)
                highs.append(start + np.maximum(2 * margin, 1) - 1 + margin)
        for k in np.unique(item[loose]):
            # A match ends at most m + e characters after its start, and its kept q-grams lie between.
            places, need, e = np.unique(at[item == k]), int(self.need[k]), int(self.edits[k])
            reach = len(self.items[k][1]) + e - self.q
            first, last = places[: len(places) - need + 1], places[need - 1 :]
            near = last - first <= reach
            owners.append(np.full(int(near.sum()), k))
            lows.append(last[near] - reach - e)
            highs.append(first[near] + e)
        owner, low, high = (np.concatenate(x).astype(np.int64) for x in (owners, lows, highs))
        order = np.lexsort((low, owner))
        now: tuple[int, int, int] | None = None
        for k, a, b in zip(owner[order].tolist(), low[order].tolist(), high[order].tolist()):
            if now and now[0] == k and a <= now[2] + 1:
                now = (k, now[1], max(now[2], b))
            else:
                if now:
                    yield now
                now = (k, a, b)
        if now:
            yield now


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most about ``BLOCK_CHARS`` characters; one block at a time is on the driver."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS) * (2 if chars > BLOCK_CHARS else 1))
    for k in range(n):
        own = benchmark if n == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in own.collect()]


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS) -> DataFrame:
    """``docs`` (text, ...) with ``matches``: the items of ``benchmark`` (item_id, text) that the text holds.

    A match has item_id, first and last (places in the normalised text, about) and edits; an item
    counts once per text, by its fewest edits. An item of fewer than ``q`` characters matches as whole words only,
    an empty or null one never. Equal items each match. A null text holds nothing. Documents are
    read once per block of the benchmark and are not shuffled.
    """
    docs = docs.drop("matches")
    added = docs.select("*", F.array().cast(_MATCHES).alias("matches"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for number, items in enumerate(_blocks(benchmark)):
        if number:  # a worker holds the tables of one block only
            added = written(added, "decontaminate-block")
        items = sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or ""))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            own = Passages(items, q, share)
            for batch in batches:
                text, before = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "matches"))
                found = [[*b, *own.search(t.as_py())] for t, b in zip(text, before.to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW)], names=batch.schema.names)

        added = added.mapInArrow(freed(run), added.schema)
    return added


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, share: float = EDITS) -> DataFrame:
    """``docs`` without those that hold a benchmark passage."""
    return find_passages(docs, benchmark, q, share).filter(F.size("matches") == 0).drop("matches")
