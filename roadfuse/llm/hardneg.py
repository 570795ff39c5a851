"""Hard negatives of anchors by segment summaries, refined step by step before exact scores.

Every vector is stored with the mean and the deviation of its segments, coarse ones first. Within a segment of m components
an inner product lies in ``m * (mean * mean' -+ deviation * deviation')``, so a sum over segments bounds the
score. Rows whose bounds can't reach an anchor's best, or can't fall into its range, go without a
score; the others meet finer segments and at last the whole vectors.

Anchors are the queries, and all rows are searched: a block of ``ANCHORS`` anchors is broadcast, each task keeps
the best of its rows for every anchor of the block, and the tasks' bests are merged by a window. Results of a block are
stored before the next one starts, so the driver never holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.llm.shared import written

#: Anchors in a block: 8 MB of 64 components, their bests take 13 MB in a task.
ANCHORS = 16_384
#: Segments of the two summaries.
SEGMENTS = (4, 16)
#: Anchors that meet a batch of rows at once; their bounds take about 8 MB at 1,000 rows.
_TILE = 512
_ROWS = 1000
_NONE = np.iinfo(np.int64).max


def _cuts(size: int, segments: int) -> np.ndarray:
    """Borders of the segments, empty ones left out."""
    return np.unique(np.linspace(0, size, segments + 1).astype(int))


def _summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the rows' segments, each times the root of the segment's size."""
    cuts = _cuts(x.shape[1], segments)
    m = np.diff(cuts).astype(float)
    if not x.size:
        return np.zeros((len(x), len(m))), np.zeros((len(x), len(m)))
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / m
    off = x - np.repeat(mean, np.diff(cuts), axis=1)
    return mean * np.sqrt(m), np.sqrt(np.add.reduceat(off * off, cuts[:-1], axis=1))


def with_summaries(vectors: DataFrame) -> DataFrame:
    """(id, label, x, then mean and deviation of each level) of ``vectors`` (id, label, x array<long>), packed as 64-bit floats.

    Shorter vectors are filled with zeros. Scores are exact while sums stay below 2^53.
    """
    size = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    names = [f"{kind}{s}" for s in SEGMENTS for kind in ("mean", "deviation")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            x = np.zeros((batch.num_rows, size))
            x[np.arange(size)[None, :] < lengths[:, None]] = batch.column(2).flatten().to_numpy()
            columns = [x]
            for s in SEGMENTS:
                columns += _summary(x, s)
            packed = [pa.array([row.tobytes() for row in c], pa.binary()) for c in columns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["id", "label", "x", *names])

    return vectors.mapInArrow(run, "id long, label long, x binary, " + ", ".join(f"{n} binary" for n in names))


class _Rows:
    """Rows of one batch, or the anchors of a block: ids, labels, whole vectors and summaries."""

    def __init__(self, columns: list, start: int, end: int):
        self.id, self.label = columns[0][start:end], columns[1][start:end]
        self.x, *rest = [np.frombuffer(b"".join(c[start:end]), np.float64).reshape(end - start, -1) for c in columns[2:]]
        self.levels = list(zip(rest[::2], rest[1::2]))

    def part(self, rows: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        out.id, out.label, out.x = self.id[rows], self.label[rows], self.x[rows]
        out.levels = [(m[rows], d[rows]) for m, d in self.levels]
        return out


def _columns(batch) -> list:
    return [batch.column(0).to_numpy(), batch.column(1).to_numpy(), *[batch.column(i).to_pylist() for i in range(2, batch.num_columns)]]


class _Best:
    """The first ``k`` rows per slot, by score (high first), then id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), -np.inf)
        self.id = np.full((slots, k), _NONE, np.int64)

    @property
    def least(self) -> np.ndarray:
        """What a row must reach at least to enter a slot."""
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        lead = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else np.zeros(0, int)
        rank = np.arange(len(slot)) - np.repeat(lead, np.diff(np.append(lead, len(slot))))
        slot, score, ids, rank = (a[rank < self.k] for a in (slot, score, ids, rank))
        touched, at = np.unique(slot, return_inverse=True)
        both_score, both_id = np.full((len(touched), 2 * self.k), -np.inf), np.full((len(touched), 2 * self.k), _NONE, np.int64)
        both_score[:, : self.k], both_id[:, : self.k] = self.score[touched], self.id[touched]
        both_score[at, self.k + rank], both_id[at, self.k + rank] = score, ids
        order = np.lexsort((both_id, -both_score), axis=1)[:, : self.k]
        self.score[touched] = np.take_along_axis(both_score, order, 1)
        self.id[touched] = np.take_along_axis(both_id, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.id != _NONE)
        return slot, self.id[slot, place], self.score[slot, place].astype(np.int64)


def _bounds(a: _Rows, b: _Rows, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of every row of ``a`` with every row of ``b``; half a unit of slack covers rounding."""
    (m, d), (n, e) = a.levels[level], b.levels[level]
    middle, spread = m @ n.T, d @ e.T
    slack = 0.5 + 1e-9 * (np.abs(middle) + spread)
    return middle - spread - slack, middle + spread + slack


def _exact(a: _Rows, b: _Rows, i: np.ndarray, j: np.ndarray, judge) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (i, j) that finer segments leave, and their scores; ``judge(i, lowest, highest)`` says which can matter.

    Where most pairs are left, whole products are cheaper than picked ones; the figures are equal.
    """
    crowded = len(i) * 8 > len(a.id) * len(b.id)
    for level in range(1, len(SEGMENTS)):
        if crowded:
            lowest, highest = _bounds(a, b, level)
            lowest, highest = lowest[i, j], highest[i, j]
        else:
            (m, d), (n, e) = a.levels[level], b.levels[level]
            middle, spread = np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", d[i], e[j])
            slack = 0.5 + 1e-9 * (np.abs(middle) + spread)
            lowest, highest = middle - spread - slack, middle + spread + slack
        left = judge(i, lowest, highest)
        i, j = i[left], j[left]
    return i, j, np.rint((a.x @ b.x.T)[i, j] if crowded else np.einsum("ij,ij->i", a.x[i], b.x[j]))


def _tiles(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Rows, np.ndarray, _Rows]]:
    """(anchors of one tile, their places in the block, rows) for all batches of rows."""
    anchors: _Rows = shared
    for batch in batches:
        columns = _columns(batch)
        for start in range(0, batch.num_rows, _ROWS):
            rows = _Rows(columns, start, min(start + _ROWS, batch.num_rows))
            for first in range(0, len(anchors.id), _TILE):
                at = np.arange(first, min(first + _TILE, len(anchors.id)))
                yield anchors.part(at), at, rows


def _kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


def _positives(vectors: DataFrame, anchors: _Rows, k: int) -> DataFrame:
    """Per task and anchor the first ``k`` other rows of its label: anchor_id, other_id, score."""
    order = np.argsort(anchors.label, kind="stable")
    shared = vectors.sparkSession.sparkContext.broadcast(anchors.part(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = _Best(len(own.id), k)
        for batch in batches:
            columns = _columns(batch)
            for start in range(0, batch.num_rows, _ROWS):
                rows = _Rows(columns, start, min(start + _ROWS, batch.num_rows))
                for label in np.unique(rows.label):
                    part = rows.part(np.flatnonzero(rows.label == label))
                    first, end = np.searchsorted(own.label, label), np.searchsorted(own.label, label, "right")
                    for tile in range(first, end, _TILE):
                        at = np.arange(tile, min(tile + _TILE, end))
                        a = own.part(at)
                        other = a.id[:, None] != part.id[None, :]
                        lowest, highest = _bounds(a, part, 0)
                        need = np.maximum(best.least[at], _kth_largest(np.where(other, lowest, -np.inf), k))
                        i, j = np.nonzero(other & (highest >= need[:, None]))
                        i, j, score = _exact(a, part, i, j, lambda i, lo, hi: hi >= need[i])  # noqa: B023
                        best.add(at[i], score, part.id[j])
        slot, ids, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(own.id[slot]), pa.array(ids), pa.array(score)], names=["anchor_id", "other_id", "score"])

    return vectors.mapInArrow(run, "anchor_id long, other_id long, score long")


def _negatives(vectors: DataFrame, anchors: _Rows, positives: dict[int, list], k: int, low: int, high: int) -> DataFrame:
    """Per task, anchor and positive the first ``k`` rows of other labels within the positive's range: anchor_id, positive_id, positive_score, other_id, score."""
    most = max([1, *map(len, positives.values())])
    known = np.full((len(anchors.id), most), np.nan)
    ids = np.zeros((len(anchors.id), most), np.int64)
    for row, anchor in enumerate(anchors.id.tolist()):
        for place, (positive, score) in enumerate(positives.get(anchor, ())):
            known[row, place], ids[row, place] = score, positive
    shared = vectors.sparkSession.sparkContext.broadcast((anchors, known, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, ids = shared.value
        # Whole scores: low * p <= 100 * s <= high * p.
        floor, top = np.ceil(low * known / 100 - 1e-9), np.floor(high * known / 100 + 1e-9)
        bests = [_Best(len(own.id), k) for _ in range(known.shape[1])]
        for a, at, rows in _tiles(own, batches):
            other = a.label[:, None] != rows.label[None, :]
            lowest, highest = _bounds(a, rows, 0)
            needs, tops = [], []
            for place, best in enumerate(bests):
                sure = other & (lowest >= floor[at, place, None]) & (highest <= top[at, place, None])
                needs.append(np.fmax(np.fmax(floor[at, place], best.least[at]), _kth_largest(np.where(sure, lowest, -np.inf), k)))
                tops.append(top[at, place])
            reach = lambda i, lo, hi: np.logical_or.reduce([(hi >= n[i]) & (lo <= t[i]) for n, t in zip(needs, tops)])  # noqa: B023, E731
            open_ = np.zeros(other.shape, bool)
            for n, t in zip(needs, tops):
                open_ |= (highest >= n[:, None]) & (lowest <= t[:, None])
            i, j = np.nonzero(other & open_)
            i, j, score = _exact(a, rows, i, j, reach)
            for place, best in enumerate(bests):
                good = (score >= needs[place][i]) & (score >= floor[at[i], place]) & (score <= tops[place][i])
                best.add(at[i[good]], score[good], rows.id[j[good]])
        for place, best in enumerate(bests):
            slot, found, score = best.rows()
            columns = [own.id[slot], ids[slot, place], known[slot, place].astype(np.int64), found, score]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])

    return vectors.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, other_id long, score long")


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of every key by score, then id, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (rank int, the others long).

    ``vectors``: id (long, distinct), label and x (array<long>); ``anchor`` says which rows are anchors. The score of two rows is their inner
    product; higher comes first, ties by smaller id. An anchor's positives are its first other rows of its label; for each of them the first
    ``negatives`` rows of other labels are given with ``low * positive <= 100 * score <= high * positive``, ranked from 1.

    Rows with a null id, label, vector or component take no part. Vectors of different lengths meet over the
    shorter one. Other columns are ignored; a table without anchors or without positives gives no rows.
    """
    spark = vectors.sparkSession
    whole = "id is not null and label is not null and x is not null and not exists(x, c -> c is null)"
    rows = vectors.withColumn("_anchor", F.coalesce(anchor, F.lit(False))).filter(whole)
    # A block is a range of places among the anchors' hashes, near its size on average.
    stored = written(with_summaries(rows.select("id", F.col("label").cast("long").alias("label"), F.col("x").cast("array<long>").alias("x"))), "negatives-vectors")
    marked = written(rows.filter("_anchor").select("id"), "negatives-anchors")
    blocks = max(1, -(-marked.count() * 5 // (4 * block)))
    place = F.pmod(F.xxhash64("id"), F.lit(blocks))
    out = None
    for number in range(blocks):
        held = stored.join(marked.filter(place == number), "id", "left_semi").toArrow().combine_chunks().to_batches()
        if not held:
            continue
        anchors = _Rows(_columns(held[0]), 0, held[0].num_rows)
        best = written(_first(_positives(stored, anchors, positives), ["anchor_id"], positives), "negatives-positives")
        known: dict[int, list] = {}
        for r in best.collect():  # at most ``positives`` rows an anchor of the block
            known.setdefault(r.anchor_id, []).append((r.other_id, r.score))
        found = _first(_negatives(stored, anchors, known, negatives, low, high), ["anchor_id", "positive_id"], negatives)
        found = written(found, "negatives-found")
        out = found if out is None else out.union(found)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out.withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"}).select(*names)


TWIN = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 10
"""
