"""Near duplicates by one-permutation hashing, banded buckets and star-shaped candidate edges.

A document is its set of distinct word shingles. One hash orders all shingles; it is cut into
``BINS`` equal ranges, and a set's signature is its smallest hash in each range. An empty range
borrows from the first filled one on a fixed random walk of its own (optimal densification), so
short texts have whole signatures, too. Signatures fall into bands of ``ROWS`` values; documents
with an equal band meet in its bucket. Two sets of Jaccard similarity 0.85 miss all 32 bands once
in 10^8.

Each bucket is a star: its smallest document is compared with all others, so candidates grow with
the postings, not with the square of a bucket. Links found so give components. What a star can't
see are pairs without its centre; they matter only where a bucket still holds two components. The
rows of such a bucket outside its main component meet all others of it in blocks inside tasks, first
as signatures, which leave few rows, then as whole sets; a task gives out one link for two
components. So no step lists the pairs of a bucket. Before, rounds link each outside row with the one it is most
like, which joins most components that are one. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import written
from roadfuse.llm.wordhash import mix, ragged, shingle_sets
from roadfuse.operators.components import connected_components

_U = np.uint64
#: Ranges of the one permutation, and signature values in a band.
BINS, ROWS = 160, 5
#: Share by which signatures may agree less than the similarity asked for; at 0.85, three pairs in 10^9 agree less.
SLACK = 20
#: Rows of a bucket, and their shingles, that one task compares with as many others.
BLOCK, BLOCK_TOKENS = 1024, 1_000_000
#: Rounds in which torn buckets link nearest rows, each with its share of the buckets; what they leave is left to whole blocks of all buckets.
ROUNDS = 3
#: Bits of the bitmap of documents whose sets are to be compared.
_MEMBERS = 25
_WALK = 64
_BAND = np.array([pow(0x9E3779B97F4A7C15, i + 2, 1 << 64) | 1 for i in range(ROWS)], _U)


@lru_cache(maxsize=None)
def _walks(part: int) -> np.ndarray:
    """Steps ``part * _WALK`` and on of every range's random walk."""
    bins = np.arange(BINS, dtype=_U)[:, None] << _U(32)
    steps = np.arange(part * _WALK, (part + 1) * _WALK, dtype=_U)[None, :]
    return (mix((bins + steps) * _U(0xC2B2AE3D27D4EB4F)) % _U(BINS)).astype(np.int64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The ``BINS`` values of a set of sorted 64-bit tokens, one at least."""
    at = (((tokens >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    filled = np.zeros(BINS, bool)
    filled[at[lead]] = True
    values = np.zeros(BINS, _U)
    values[at[lead]] = tokens[lead]
    empty, part = np.flatnonzero(~filled), 0
    while len(empty):
        walk = _walks(part)[empty] if part < 64 else mix((empty[:, None].astype(_U) << _U(32)) + np.arange(part * _WALK, (part + 1) * _WALK, dtype=_U)) % _U(BINS)
        hit = filled[walk]
        done = hit.any(1)
        values[empty[done]] = values[walk[done, hit[done].argmax(1)]]
        empty, part = empty[~done], part + 1
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    rows = mix(values).reshape(-1, ROWS)
    return mix((rows * _BAND).sum(1, dtype=_U) + np.arange(len(rows), dtype=_U))


def index(docs: DataFrame, k: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, the set's digest, a byte per signature value, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, marks, keys = [], [], [], []
            for tokens in shingle_sets(batch.column(1), k):
                sizes.append(len(tokens))
                if not len(tokens):
                    for column in (digests, marks, keys):
                        column.append(None)
                    continue
                values = signature(tokens)
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                marks.append(mix(values).astype(np.uint8).tobytes())
                keys.append(bands(values).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "marks", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, marks binary, bands array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _fits(n: Column, m: Column, share: int) -> Column:
    return (n * 100 >= m * share) & (m * 100 >= n * share)


def _alike(pairs: DataFrame, marks: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in enough ranges."""
    least = (share - SLACK) * BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(agree * 100 >= least))

    left = marks.select(F.col("doc_id").alias("a"), F.col("marks").alias("x"))
    right = marks.select(F.col("doc_id").alias("b"), F.col("marks").alias("y"))
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ``ids`` (doc_id), without a shuffle of texts.

    They are marked in a bitmap of fixed size by a hash of doc_id; a few others fall on the same bits, and their sets meet nothing.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _MEMBERS))
    marks = ids.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits"))
    bitmap = bytearray(1 << (_MEMBERS - 3))
    for r in marks.collect():
        bitmap[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            wanted = batch.filter(pa.array((marked[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for start in range(0, wanted.num_rows, 64):
                part = wanted.slice(start, 64)
                own = [s.tobytes() for s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["doc_id", "tokens"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text", place.alias("at"))
    return rows.mapInArrow(run, "doc_id long, tokens binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only the texts they name are cut into shingles again."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sets = written(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), k), "minhash-star-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal ``keys``, across the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is not None and tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        start = 0
        for cut in np.flatnonzero(new):
            if cut > start:
                held.append(batch.slice(start, cut - start))
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, start = [], int(cut)
        held.append(batch.slice(start))
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _torn(members: DataFrame, component: DataFrame) -> DataFrame:
    """(key, doc_id, n, c, outside, lefts, rights): rows of the buckets of ``members`` (key, doc_id, n) that hold two components.

    Rows outside a bucket's main component are to be cut into ``lefts`` blocks, all its rows into ``rights`` blocks.
    """
    placed = written(members.join(component.hint("merge"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")), "minhash-placed")
    sums = placed.groupBy("key", "c").agg(F.count("*").alias("held"), F.sum("n").alias("tokens"))
    main = sums.groupBy("key").agg(
        F.max_by(F.struct("c", "held", "tokens"), F.struct("held", "c")).alias("main"), F.sum("held").alias("held"), F.sum("tokens").alias("tokens")
    )
    blocks = lambda held, tokens: F.ceil(F.greatest(held / BLOCK, tokens / BLOCK_TOKENS)).cast("int")
    rights = blocks(F.col("held"), F.col("tokens"))
    lefts = blocks(F.col("held") - F.col("main.held"), F.col("tokens") - F.col("main.tokens"))
    main = main.filter("held > main.held").select("key", F.col("main.c").alias("main"), rights.alias("rights"), lefts.alias("lefts"))
    torn = placed.join(written(main, "minhash-mains"), "key")
    return written(torn.select("key", "doc_id", "n", "c", (F.col("c") != F.col("main")).alias("outside"), "lefts", "rights"), "minhash-torn")


def _look_alike(torn: DataFrame, signs: DataFrame, share: int, nearest: bool) -> DataFrame:
    """What of ``torn`` looks like a row of another component of its bucket. ``signs``: doc_id, marks, bands.

    With ``nearest`` pairs (a, b): every row outside the main component with the one it is most like. Else all rows of such pairs:
    (key, i, j, is_left, doc_id, n, c); two documents count in the first bucket they share only. A task compares one block of
    rows outside the main component with one of all rows, so a bucket of m rows, k of them outside, sends
    about m + k rows per block of the other side.
    """
    least = (share - SLACK) * BINS
    torn = torn.hint("merge").join(signs, "doc_id")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["doc_id", "n", "c", "outside", "marks", "bands"]
    left = torn.filter("outside").select("key", own("lefts").alias("i"), every("rights").alias("j"), F.lit(True).alias("is_left"), *kept)
    right = torn.select("key", every("lefts").alias("i"), own("rights").alias("j"), F.lit(False).alias("is_left"), *kept)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            is_left, doc, n, c, outside = (group.column(x).to_numpy(zero_copy_only=False) for x in ("is_left", "doc_id", "n", "c", "outside"))
            lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            signs = _matrix(group.column("marks"))
            keys = group.column("bands").flatten().to_numpy().reshape(-1, BINS // ROWS)
            here = int(np.flatnonzero(keys[0] == group.column("key")[0].as_py())[0])
            used = np.zeros(len(doc), bool)
            a, b = [], []
            for x in lefts:
                good = (c[rights] != c[x]) & (nearest | ~outside[rights] | (doc[rights] > doc[x]))
                good &= (n[rights] * 100 >= n[x] * share) & (n[x] * 100 >= n[rights] * share)
                near = rights[good]
                agree = (signs[near] == signs[x]).sum(1)
                if nearest:
                    if len(near) and agree.max() * 100 >= least:
                        y = doc[near[agree.argmax()]]
                        a.append(min(doc[x], y))
                        b.append(max(doc[x], y))
                    continue
                near = near[agree * 100 >= least]
                near = near[(keys[near] == keys[x]).argmax(1) == here]
                used[near] = True
                used[x] |= len(near) > 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            if used.any():
                yield group.select(["key", "i", "j", "is_left", "doc_id", "n", "c"]).filter(pa.array(used))

    rows = left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = "a long, b long" if nearest else "key long, i int, j int, is_left boolean, doc_id long, n int, c long"
    return rows.mapInArrow(compare, schema)


def _links_across(torn: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b): per group of ``torn`` one confirmed link for every two components that it can join, less those that others join."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["key", "i", "j"]):
            is_left, doc, c = (group.column(x).to_numpy(zero_copy_only=False) for x in ("is_left", "doc_id", "c"))
            tokens = [np.frombuffer(x.as_buffer(), "<u8") for x in group.column("tokens")]
            n = np.array([len(t) for t in tokens])
            lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            flat = np.concatenate([*(tokens[r] for r in rights), np.zeros(0, _U)])
            holder = np.repeat(np.arange(len(rights)), n[rights])
            order = np.argsort(flat, kind="stable")
            flat, holder = flat[order], holder[order]
            joined = c.copy()
            a, b = [], []
            for x in lefts:
                first, end = np.searchsorted(flat, tokens[x]), np.searchsorted(flat, tokens[x], "right")
                common = np.bincount(holder[ragged(first, end - first)], minlength=len(rights))
                for y in rights[100 * common >= share * (n[x] + n[rights] - common)]:
                    if joined[x] != joined[y]:
                        joined[joined == joined[y]] = joined[x]
                        a.append(min(doc[x], doc[y]))
                        b.append(max(doc[x], doc[y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = torn.join(sets, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than ASCII white space, with A-Z in lower case. Two documents link when
    ``100 * intersection >= share * union`` of their sets of ``k``-word shingles; fewer words make one
    shingle, none (or a null text) an empty set, which links with nothing. ``component_id`` is the
    smallest doc_id reachable, and only that document is kept. Rows of one doc_id are one document; a null doc_id
    links with nothing, has no component and is kept. Other columns are ignored. An empty table gives no rows.
    The bands are laid out for ``share`` of 80 or more. Equal sets are found by a 128-bit digest, and
    only the smallest doc_id of each enters the buckets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Large tables are merged at every size: a broadcast would only last as long as the other side is small.
    nodes = written(index(docs, k), "minhash-index")
    keyed = nodes.filter("digest is not null and doc_id is not null").withColumnRenamed("n_shingles", "n")
    same = keyed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    owners = keyed.join(written(same, "minhash-digests").hint("merge"), "digest", "left")
    owners = written(owners.withColumn("bands", F.when(F.coalesce(F.col("doc_id") == F.col("least"), F.lit(True)), F.col("bands"))), "minhash-owners")
    equal = owners.filter("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    signs = owners.filter("bands is not null").select("doc_id", "marks", "bands")

    posts = owners.select("doc_id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    centre = posts.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("held"))
    centre = centre.filter("low.doc_id < high").select("key", F.col("low.doc_id").alias("low"), F.col("low.n").alias("m"), "held")
    centre = written(centre, "minhash-buckets")
    members = written(posts.join(centre.hint("merge"), "key"), "minhash-members")
    star = members.filter("doc_id <> low").filter(_fits(F.col("n"), F.col("m"), share))
    star = star.select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = written(_alike(star, signs.select("doc_id", "marks"), share), "minhash-star")
    links = written(equal.union(_confirmed(star, docs, k, share)), "minhash-links")

    # Buckets of a centre and one more hold no other pair.
    rest = members.filter("doc_id <> low and held > 2").select("key", "doc_id", "n")
    signs = written(signs.join(rest.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "minhash-signs")
    for number in range(ROUNDS):
        component = connected_components(links).withColumnsRenamed({"node": "doc_id", "component": "c"})
        torn = _torn(rest.filter(F.pmod("key", F.lit(ROUNDS)) == number), component)
        nearest = written(_look_alike(torn, signs, share, nearest=True).distinct(), "minhash-nearest")
        links = links.union(written(_confirmed(nearest, docs, k, share), "minhash-nearest-links"))
    component = connected_components(links).withColumnsRenamed({"node": "doc_id", "component": "c"})
    alike = written(_look_alike(_torn(rest, component), signs, share, nearest=False), "minhash-torn-alike")
    sets = written(_sets(docs, alike.select("doc_id"), k), "minhash-torn-sets")
    found = written(_links_across(alike, sets, share), "minhash-links-across")
    component = connected_components(links.union(found)).select(F.col("node").alias("doc_id"), "component")
    top = F.coalesce("component", "doc_id")
    return (
        nodes.select("doc_id", "n_shingles")
        .join(component, "doc_id", "left")
        .select("doc_id", "n_shingles", top.alias("component_id"), F.coalesce(F.col("doc_id") == top, F.lit(True)).alias("kept"))
    )


TWIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, text,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), edge AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reached AS (
  SELECT a AS doc_id, b AS other FROM edge
  UNION
  SELECT r.doc_id, e.b FROM reached r JOIN edge e ON e.a = r.other
), least AS (
  SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least USING (doc_id)
"""
