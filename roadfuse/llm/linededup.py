"""Repeated runs of lines, found by winnowing over line hashes; only the first occurrence stays.

A window is the shortest run of whole lines from a given line on, or up to a given line, that holds ``min_words`` words.
Of each window the line with the most words (ties: smallest hash, then first) is its fingerprint,
so two texts that share a window share its fingerprint, and neighbouring windows mostly share
theirs. Fingerprints that stand in more than one place are joined by position with the windows
around them. A window whose lines all stood earlier, in a smaller doc_id or higher up in the same
text, is repeated. Every shared run of ``min_words`` words or more is found, because it holds a window, and the windows from
its first line on and up to its last line extend the match to both sides, so that the whole run goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import freed, unused, written
from roadfuse.llm.wordhash import hash_spans, mix, pieces, ragged, strings, word_spans

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_WINDOWS = "line_hash long, windows array<struct<first: int, last: int, hash: long>>"


def windows(raw: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(row, first line, end line, window hash, fingerprint line's hash, fingerprint) of every window, by fingerprint."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((breaks, offsets[1:])))
    rows = np.sort(np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1)))
    n = len(starts)
    word_at, _, _ = word_spans(raw, offsets)
    upto = np.searchsorted(word_at, ends)
    since = np.searchsorted(word_at, starts)
    words = upto - since
    h = hash_spans(raw, starts, ends)
    first_line = np.searchsorted(rows, np.arange(len(offsets)))  # of each row, and the end
    total = np.concatenate(([0], np.cumsum(words)))
    first = np.arange(n)
    end = np.searchsorted(total, total[first] + min_words)
    inside = end <= first_line[rows[first] + 1]
    first, end = first[inside], end[inside]
    upto_line = np.arange(1, n + 1)
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    # Without those that are also the shortest from their first line on.
    more = (back >= first_line[rows]) & (total[:-1] - total[back] >= min_words)
    first, end = np.concatenate((first, back[more])), np.concatenate((end, upto_line[more]))
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U), none.astype(_U), none
    power = np.cumprod(np.concatenate(([_U(1)], np.full(n, _BASE))))
    inverse = np.cumprod(np.concatenate(([_U(1)], np.full(n, _INVERSE))))
    prefix = np.concatenate(([_U(0)], np.cumsum(h * power[:-1])))
    key = mix((prefix[end] - prefix[first]) * inverse[first] + (end - first).astype(_U) * _BASE)
    # Window minima of (fewest words last, hash, place) by doubling, over the lines' ranks in that order.
    by_rank = np.lexsort((h, -words))
    rank = np.empty(n, np.int64)
    rank[by_rank] = np.arange(n)
    levels = [rank]
    for k in range(int(np.log2((end - first).max()))):
        own, step = levels[-1], 1 << k
        levels.append(np.minimum(own[: len(own) - step], own[step:]))
    level = np.log2(end - first).astype(np.int64)
    best = np.empty(len(first), np.int64)
    for k in np.unique(level):
        at = level == k
        best[at] = np.minimum(levels[k][first[at]], levels[k][end[at] - (1 << k)])
    mark = by_rank[best]
    # All windows of a fingerprint side by side.
    by = np.argsort(mark, kind="stable")
    first, end, key, mark = first[by], end[by], key[by], mark[by]
    row = rows[first]
    return row, first - first_line[row], end - first_line[row], key, h[mark], mark


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """Per fingerprint: its document, the line's hash, and the windows it stands for. ``docs``: doc_id, doc_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = strings(batch.column(2))
            for a, b in pieces(raw, offsets):
                own_raw, own_offsets = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, first, end, key, line, mark = windows(own_raw, own_offsets, min_words)
                if not len(row):
                    continue
                lead = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
                bounds = np.append(lead, len(row)).astype(np.int32)
                inner = pa.StructArray.from_arrays([first.astype(np.int32), end.astype(np.int32), key.view(np.int64)], names=["first", "last", "hash"])
                own = pa.array(row[lead] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(line[lead].view(np.int64)), pa.ListArray.from_arrays(bounds, inner)],
                    names=["doc_id", "doc_hash", "line_hash", "windows"],
                )

    return docs.mapInArrow(freed(run), f"doc_id long, doc_hash long, {_WINDOWS}")


def repeated_windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, doc_hash, first, last): windows of lines that stood earlier; lines count from 0, ``last`` is excluded."""
    prints = written(fingerprints(docs, min_words), "line-fingerprints")
    # Counts and first places are summed before the shuffle and stored, so that the joins below
    # meet two plain shuffles, whose hot keys Spark splits.
    twice = written(prints.groupBy("line_hash").agg(F.count("*").alias("n")).filter("n > 1").select("line_hash"), "line-repeats")
    found = prints.join(twice, "line_hash", "left_semi").select("doc_id", "doc_hash", F.inline("windows").alias("first", "last", "hash"))
    found = written(found, "line-windows")
    place = F.struct("doc_id", "doc_hash", "first", "last")
    earliest = written(
        found.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("o")).filter("n > 1").select("hash", "o"), "line-first-places"
    )
    elsewhere = ~(F.col("doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("doc_hash") == F.col("o.doc_hash")))
    return (
        found.join(earliest, "hash")
        .filter(elsewhere | (F.col("first") >= F.col("o.last")))
        .select("doc_id", "doc_hash", "first", "last")
    )


def _covered(first: np.ndarray, last: np.ndarray, lines: int) -> np.ndarray:
    edge = np.bincount(first, minlength=lines + 1) - np.bincount(last, minlength=lines + 1)
    return np.cumsum(edge)[:lines] > 0


def delete_repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the later occurrences of runs of lines of ``min_words`` words or more.

    The whole run goes, however short its first and last lines are.

    Adds n_lines and n_deleted (long), replacing columns of these names; other columns stay. A run
    that repeats itself inside a text loses the repeats that don't overlap its first occurrence.
    Rows equal in doc_id and text are one document and keep the same lines; a null doc_id comes
    before all others, and different texts of one doc_id are ordered by a hash. A null text stays null with 0 lines; shorter runs, and lines that repeat
    singly with fewer words, stay.
    """
    docs = docs.drop("n_lines", "n_deleted")
    hashed, at_doc, at_hash, spans_of = (unused(c, docs.columns) for c in ("_hash", "_doc", "_doc_hash", "_spans"))
    docs = docs.withColumn(hashed, F.xxhash64("text"))
    spans = (
        repeated_windows(docs.select(F.col("doc_id").cast("long"), F.col(hashed).alias("doc_hash"), "text"), min_words)
        .groupBy("doc_id", "doc_hash")
        .agg(F.collect_set(F.struct("first", "last")).alias(spans_of))
        .select(F.col("doc_id").alias(at_doc), F.col("doc_hash").alias(at_hash), spans_of)
    )
    spans = written(spans, "line-spans")
    # Sorted and merged at every size: a broadcast would only last as long as few runs repeat.
    joined = docs.join(spans.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(at_doc)) & (F.col(hashed) == F.col(at_hash)), "left")
    joined = joined.drop(at_doc, at_hash, hashed)
    names = [c for c in joined.columns if c != spans_of]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = (batch.column(batch.schema.get_field_index(c)) for c in ("text", spans_of))
            bounds, inner = spans.offsets.to_numpy(), spans.values
            first, last = (inner.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            repeated = spans.is_valid().to_numpy(zero_copy_only=False)
            out, lines, deleted = [], [], []
            for k, value in enumerate(text):
                t = value.as_py()
                own = [] if t is None else t.split("\n")
                gone = np.zeros(len(own), bool)
                if repeated[k] and t is not None:
                    gone = _covered(first[bounds[k] : bounds[k + 1]], last[bounds[k] : bounds[k + 1]], len(own))
                out.append("\n".join(x for x, g in zip(own, gone) if not g) if gone.any() else t)
                lines.append(len(own))
                deleted.append(int(gone.sum()))
            columns = [pa.array(out, batch.schema.field(c).type) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(deleted, pa.int64())], names=[*names, "n_lines", "n_deleted"])

    none = F.lit(None).cast("long")
    return joined.mapInArrow(freed(run), joined.select(*names, none.alias("n_lines"), none.alias("n_deleted")).schema)


#: DuckDB SQL for doc_id, n_lines, n_deleted and the kept text's SHA-256 over ``documents``.
TWIN = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, i, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM docs)
),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM lines),
worded AS (SELECT *, upto - words AS before FROM sums WHERE words > 0),
wins AS (
  SELECT a.doc_id, a.i AS first, b.i AS last
  FROM (SELECT *, upto - words + 50 AS need FROM sums) a
  ASOF JOIN worded b ON a.doc_id = b.doc_id AND a.need <= b.upto
  UNION
  SELECT b.doc_id, a.i, b.i
  FROM (SELECT *, upto - 50 AS room FROM sums) b
  ASOF JOIN worded a ON a.doc_id = b.doc_id AND b.room >= a.before
),
keyed AS (SELECT w.*, md5(array_to_string(d.lines[w.first:w.last], chr(10))) AS k FROM wins w JOIN docs d USING (doc_id)),
placed AS (
  SELECT *, first_value(doc_id) OVER o AS d0, first_value(last) OVER o AS l0, row_number() OVER o AS n
  FROM keyed WINDOW o AS (PARTITION BY k ORDER BY doc_id, first)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM placed WHERE n > 1 AND (doc_id <> d0 OR first > l0)
),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_deleted,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_deleted, sha256(text) AS text_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
