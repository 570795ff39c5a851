"""N-gram Jaccard self-join by token-combination prefixes, and its connected documents.

A document is its set of distinct word shingles (tokens). Two sets of Jaccard similarity s or more
miss at most ``len // 4`` (for s = 0.75) of each other's tokens. All tokens stand in one global
order, and tokens fall into two classes: rare ones are indexed singly, frequent ones as pairs. A
prefix is long enough when its rare tokens, plus its frequent tokens less one per sub-class,
exceed the number of tokens that may be missing; then two similar sets share a rare token or a
pair of frequent tokens of one sub-class. Any order and any classes keep this exact, so the
classes come from a bitmap of counted tokens of bounded size. Frequent tokens fall into sub-classes by
hash, about 16 tokens of a document to each, which keeps the number of pairs in proportion to its
length; sub-classes depend on the power of two in the set's size, and a document near such a power
is indexed for both sides.

Candidates meet in the buckets of a signature. First each document is verified against its
bucket's smallest one. Linked documents count as one component. Documents that candidates hold
together are a group, similar or not; what is left of it in different components is compared in
blocks inside tasks, which give out links only. Pairs across groups are few and are verified at
last; buckets of ``CROWD`` documents or more make a group, so those pairs come from small buckets
only and grow with the postings. Copies and near copies are never expanded into all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import freed, freed_group, power_of_two, slices, text_bytes, written
from roadfuse.llm.wordhash import mix, ragged, shingle_sets
from roadfuse.operators.components import connected_components

_U = np.uint64
#: Bits of the bitmap of tokens of two documents or more, at most; that of frequent tokens has a quarter of them.
TWICE = 27
#: Documents that make a token frequent at least.
FREQUENT = 24
#: Bits of the bitmap of documents whose sets are to be compared.
_MEMBERS = 24
#: Documents in a bucket that are compared as a group.
CROWD = 32
#: Tokens in a block of a group whose documents are all compared.
BLOCK_TOKENS = 500_000
#: Tokens of a document in one sub-class of frequent tokens, as a power of two.
_SUBCLASS = 4
#: Bytes of text whose tokens one counting task holds.
_COUNT_BYTES = 1 << 24
#: Bytes of text whose sets a task holds at once.
_SLICE = 1 << 21


def _tokens(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Per batch and bucket (the tokens' first ``bits`` bits): their next 32 bits, and how many texts hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, _SLICE)):
            tokens, counts = np.unique(np.concatenate([*shingle_sets(batch.column(0), k), np.zeros(0, _U)]), return_counts=True)
            cuts = np.searchsorted(tokens, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits))
            low = ((tokens >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype("<u4")
            parts = [(b, x, c) for b, (x, c) in enumerate(zip(np.split(low, cuts), np.split(counts, cuts))) if len(x)]
            many = [np.flatnonzero(c > 1) for _, _, c in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in parts], pa.int32()),
                    pa.array([x.tobytes() for _, x, _ in parts], pa.binary()),
                    pa.array([m.astype("<u4").tobytes() for m in many], pa.binary()),
                    pa.array([c[m].astype("<u4").tobytes() for m, (_, _, c) in zip(many, parts)], pa.binary()),
                ],
                names=["bucket", "tokens", "many", "times"],
            )

    return docs.mapInArrow(freed(run), "bucket int, tokens binary, many binary, times binary")


def token_bitmaps(docs: DataFrame, k: int) -> tuple[bytes, bytes]:
    """Bitmaps over the first bits of tokens: those of ``FREQUENT`` texts or more, and those of two or more.

    They have four bits and one bit per token, up to a fixed size, and each bucket makes its own
    stretch of them. Where they get crowded, rare tokens count as frequent, or as shared, too; that
    costs time and loses no result. Tokens are counted over all texts, summed per batch before the shuffle.
    """
    size = text_bytes(docs)
    bits = min(16, power_of_two(size / _COUNT_BYTES, 16).bit_length() - 1)
    shared = min(TWICE, power_of_two(size * 4 / 6, 1 << 20).bit_length() - 1)
    often = shared - 2

    def stretch(tokens: np.ndarray, size: int) -> bytes:
        marks = np.zeros(1 << (size - bits), bool)
        marks[tokens >> np.uint32(32 - size + bits)] = True
        return np.packbits(marks, bitorder="little").tobytes()

    def count(group: pa.Table) -> pa.Table:
        tokens, times = [], []
        for t, m, n in zip(*(group.column(name) for name in ("tokens", "many", "times"))):
            own = np.frombuffer(t.as_buffer(), "<u4")
            number = np.ones(len(own), np.int32)
            number[np.frombuffer(m.as_buffer(), "<u4")] = np.frombuffer(n.as_buffer(), "<u4")
            tokens.append(own)
            times.append(number)
        both, n = np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order]
        lead = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        number = np.add.reduceat(n, lead)
        own = both[lead]
        return pa.table(
            {
                "bucket": group.column("bucket").slice(0, 1),
                "frequent": pa.array([stretch(own[number >= FREQUENT], often)], pa.binary()),
                "twice": pa.array([stretch(own[number > 1], shared)], pa.binary()),
            }
        )

    found = (
        _tokens(docs.select("text"), k, bits).groupBy("bucket").applyInArrow(freed_group(count), "bucket int, frequent binary, twice binary").collect()
    )
    frequent, twice = bytearray(1 << (often - 3)), bytearray(1 << (shared - 3))
    for r in found:
        for bitmap, own in ((frequent, r.frequent), (twice, r.twice)):
            bitmap[r.bucket * len(own) : (r.bucket + 1) * len(own)] = own
    return bytes(frequent), bytes(twice)


def _marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _in_bitmap(bitmap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    size = (len(bitmap) * 8).bit_length() - 1
    return _marked(bitmap, (tokens >> _U(64 - size)).astype(np.int64))


def _missing(n: int, share: int) -> int:
    return n - -(-share * n // 100)


def _levels(n: int, share: int) -> list[int]:
    """Powers of two of the sizes that a set of size n can be similar to."""
    return list(range((-(-share * n // 100)).bit_length() - 1, (100 * n // share).bit_length()))


def signatures(tokens: np.ndarray, frequent: np.ndarray, twice: np.ndarray, share: int) -> np.ndarray:
    """Signatures of one set of sorted tokens; two similar sets share one, unless both are one equal token.

    Tokens that no other text holds fill the prefix, but aren't given out.
    """
    n = len(tokens)
    need = _missing(n, share) + 1
    often = _in_bitmap(frequent, tokens)
    rare = tokens[~often][:need]
    rare = rare, rare[_in_bitmap(twice, rare)]
    if len(rare[0]) == need:
        return rare[1]
    rest, out = tokens[often], [rare[1]]
    missing = need - len(rare[0])
    for level in _levels(n, share):
        classes = 1 << max(0, level - _SUBCLASS)
        own = ((rest >> _U(20)) % _U(classes)).astype(np.int64)
        _, leads = np.unique(own, return_index=True)
        adds = np.ones(len(rest), np.int64)
        adds[leads] = 0
        upto = np.cumsum(adds)
        cut = int(np.searchsorted(upto, missing)) + 1
        order = np.argsort(own[:cut], kind="stable")
        part, own = rest[:cut][order], own[:cut][order]
        for lag in range(1, len(part)):
            same = own[lag:] == own[:-lag]
            if not same.any():
                break
            a, b = part[:-lag][same], part[lag:][same]
            out.append(mix(a * _U(0x9E3779B97F4A7C15) + mix(b) + _U(level)))
    return np.unique(np.concatenate(out))


def indexed(docs: DataFrame, bitmaps: tuple[bytes, bytes], k: int, share: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, the set's digest and its signatures.

    Of equal sets in one batch only the one of the smallest doc_id carries signatures.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, twice = (np.frombuffer(x, np.uint8) for x in shared.value)
        for batch in (part for whole in batches for part in slices(whole, 1, _SLICE)):
            ids = batch.column(0).to_pylist()
            sets = list(shingle_sets(batch.column(1), k))
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            first: dict[bytes, int] = {}
            for i, d in enumerate(digests):
                if d is not None and ids[i] is not None and (d not in first or ids[i] < ids[first[d]]):
                    first[d] = i
            chosen = set(first.values())
            own = [signatures(s, frequent, twice, share) if i in chosen else np.zeros(0, _U) for i, s in enumerate(sets)]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
            flat = np.concatenate([*own, np.zeros(0, _U)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(bounds, flat)],
                names=["doc_id", "n_shingles", "digest", "signatures"],
            )

    return docs.mapInArrow(freed(run), "doc_id long, n_shingles long, digest binary, signatures array<long>")


def _sets(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens) of the documents in ``pairs``, without a shuffle of texts.

    The documents are marked in a bitmap of fixed size by a hash of doc_id; a few others fall on
    the same bits, and their sets meet no pair.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << _MEMBERS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(place("id").alias("at"))
    marks = ids.groupBy(F.shiftright("at", 15).alias("part")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits")
    )
    bitmap = bytearray(1 << (_MEMBERS - 3))
    for r in marks.collect():
        bitmap[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            at = batch.column(2).to_numpy()
            wanted = batch.filter(pa.array(_marked(marked, at)))
            for start in range(0, wanted.num_rows, 256):
                part = wanted.slice(start, 256)
                own = [s.tobytes() for s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["doc_id", "tokens"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text", place("doc_id").alias("at"))
    return rows.mapInArrow(freed(run), "doc_id long, tokens binary")


def _verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= share * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(freed(run), "a long, b long")


def _candidates(pairs: DataFrame, share: int) -> DataFrame:
    """Distinct (a, b) of ``pairs`` (a, b, sizes n and m; a row per shared signature) that can be similar.

    Sizes must fit. And of the set whose prefix ends first, all tokens but the last
    ``ceil(share * size) - 1`` count towards the shared signatures: each shared rare token is one, and f shared frequent
    tokens of one sub-class make f - 1 pairs at least, as many as the prefix was made longer for.
    So a pair with fewer shared signatures than the overlap asked for, less that tail, isn't similar.
    """
    fits = (F.col("n") * 100 >= F.col("m") * share) & (F.col("m") * 100 >= F.col("n") * share)
    behind = F.ceil(F.greatest("n", "m") * share / 100) - 1
    asked = F.ceil((F.col("n") + F.col("m")) * share / (100 + share) - F.lit(1e-9))
    counted = pairs.filter(fits).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
    return counted.filter(F.col("c") + behind >= asked).select("a", "b")


def _within_groups(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Similar pairs (a, b) of one group and different components; ``members``: doc_id, g, c, n.

    A group is cut into blocks of about ``BLOCK_TOKENS`` tokens by a hash of doc_id, and a task compares two
    blocks: it counts common tokens with array operations and gives out nothing but links.
    """
    torn = members.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum("n").alias("tokens")).filter("low < high")
    blocks = F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks")
    torn = written(torn.select("g", blocks), "jaccard-torn-groups")
    rows = members.join(torn, "g").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.join(sets, "doc_id").select("g", "doc_id", "c", "own", "tokens", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "c", "tokens")

    def compare(table: pa.Table) -> pa.Table:
        ids, parts, own = (table.column(x).to_numpy() for x in ("doc_id", "c", "own"))
        tokens = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("tokens")]
        n = np.array([len(x) for x in tokens])
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        flat = np.concatenate([*(tokens[r] for r in right), np.zeros(0, _U)])
        holder = np.repeat(np.arange(len(right)), n[right])
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], holder[order]
        out: list[tuple[int, int]] = []
        for row in left:
            first, end = np.searchsorted(flat, tokens[row]), np.searchsorted(flat, tokens[row], "right")
            common = np.bincount(holder[ragged(first, end - first)], minlength=len(right))
            good = (100 * common >= share * (n[row] + n[right] - common)) & (parts[right] != parts[row])
            if i == j:
                good &= ids[right] > ids[row]
            out += [(int(ids[row]), int(ids[r])) for r in right[good]]
        return pa.table({"a": pa.array([min(x) for x in out], pa.int64()), "b": pa.array([max(x) for x in out], pa.int64())})

    return rows.groupBy("g", "i", "j").applyInArrow(freed_group(compare), "a long, b long")


def link_components(docs: DataFrame, k: int = 5, share: int = 75) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of other bytes than ASCII white space with A-Z in lower case. Two documents
    link when ``100 * intersection >= share * union`` of their sets of ``k``-word shingles; fewer
    words make one shingle, none an empty set, which links with nothing. The component is the
    smallest doc_id reachable. Rows of one doc_id are one document; a null doc_id links with nothing and
    has no component. Equal sets are grouped by a 128-bit digest and not compared.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = written(indexed(docs, token_bitmaps(docs, k), k, share), "jaccard-index")
    keyed = nodes.filter("digest is not null and doc_id is not null")
    smallest = written(keyed.groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n"), "jaccard-digests")
    equal = keyed.join(smallest, "digest").filter("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    equal = written(equal, "jaccard-equal")

    posts = keyed.select("doc_id", F.col("n_shingles").cast("int").alias("n"), F.explode("signatures").alias("s"))
    place = F.struct("doc_id", "n")
    low = posts.groupBy("s").agg(F.min(place).alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("held")).filter("low.doc_id < high")
    shared = written(low.select("s", F.col("low.doc_id").alias("low"), F.col("low.n").alias("m"), "held"), "jaccard-buckets")
    buckets = written(posts.join(shared, "s"), "jaccard-posts")
    star = _candidates(buckets.filter("doc_id <> low").select(F.col("low").alias("a"), F.col("doc_id").alias("b"), "n", "m"), share)
    star = written(star, "jaccard-star")
    # Buckets of many documents make them one group too, so that only small buckets are left to pair their documents across groups.
    crowd = buckets.filter((F.col("held") >= CROWD) & (F.col("doc_id") > F.col("low"))).select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    crowd = written(crowd.distinct(), "jaccard-crowds")
    sets = written(_sets(docs, star.union(crowd), k), "jaccard-sets")
    links = written(equal.union(_verified(star, sets, share)), "jaccard-links")

    # Documents that candidate pairs hold together, whether they are similar or not, are compared block by block inside tasks.
    group = written(connected_components(equal.union(star).union(crowd)), "jaccard-groups").withColumnsRenamed({"node": "doc_id", "component": "g"})
    component = connected_components(links).withColumnsRenamed({"node": "doc_id", "component": "c"})
    sizes = nodes.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    every = group.union(group.select("g", "g").distinct()).distinct().join(equal.select(F.col("a").alias("doc_id")), "doc_id", "left_anti")
    members = every.join(component, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")).join(sizes, "doc_id")
    members = written(members, "jaccard-members")
    within = written(_within_groups(members, sets, share), "jaccard-within-links")

    # What is left: pairs of one bucket in different groups, without those of its main one among themselves.
    placed = buckets.select("s", "doc_id", "n").join(group, "doc_id", "left").select("s", "doc_id", "n", F.coalesce("g", "doc_id").alias("g"))
    placed = written(placed, "jaccard-placed")
    sums = placed.groupBy("s", "g").agg(F.count("*").alias("k"))
    main = sums.groupBy("s").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
    main = written(main.select("s", "main"), "jaccard-mixed")
    mixed = written(placed.join(main, "s"), "jaccard-mixed-posts")
    other = mixed.filter("g <> main").select("s", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("g").alias("d"))
    across = (
        mixed.join(other, "s")
        .filter((F.col("g") != F.col("d")) & ((F.col("g") == F.col("main")) | (F.col("doc_id") < F.col("b"))))
        .select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b"), "n", "m")
    )
    # Each bucket that a pair shares names the pair once, so the counts are complete and pairs below the bound can't be similar.
    across = written(_candidates(across, share), "jaccard-across")
    found = written(_verified(across, written(_sets(docs, across, k), "jaccard-across-sets"), share), "jaccard-across-links")
    links = links.union(within).union(found)
    both = connected_components(links).select(F.col("node").alias("doc_id"), "component")
    return (
        nodes.select("doc_id", "n_shingles")
        .join(both, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )
