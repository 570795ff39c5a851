"""Language identification by nearest centroid over TF-IDF vectors of character n-grams.

Training learns from a bounded sample of labelled documents per language (``SAMPLE`` documents,
chosen by a hash of the document's id), while document frequencies count all labelled documents.
The sample of each language is split into ``CENTROIDS`` clusters by spherical k-means in a task of
its own; clusters of a few rows, as mislabelled texts make them, give no centroid. A text gets the
language of the centroid with the highest cosine. It is rejected if its cosine is far below what
nearly all training texts of that centroid reached, or, for a text of few n-grams, far below all
texts of few n-grams in its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import freed, remembered
from roadfuse.llm.wordhash import mix

#: Hashed n-gram features; lengths of the n-grams in characters.
DIMENSIONS, SIZES = 4096, (2, 3)
#: Bound of the labelled documents that clusters are fitted on, per language; their whole texts count.
SAMPLE = 600
CENTROIDS = 4
#: Share of a language's rows that a cluster needs to be a centroid.
SMALLEST = 0.02
#: A text is rejected whose cosine is below ``REJECT_SHARE`` of what all but ``REJECT_TAIL`` of its centroid's training
#: texts reach; one of fewer n-grams than ``ENOUGH_GRAMS``, below ``REJECT_SHORT`` of the lowest of such texts in its language.
REJECT_SHARE, REJECT_TAIL, REJECT_SHORT, ENOUGH_GRAMS = 0.5, 0.02, 0.3, 200


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters than letters as one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _squeeze(points)


def _is_letter() -> np.ndarray:
    return remembered(("letters",), lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def _squeeze(points: np.ndarray) -> np.ndarray:
    letter = _is_letter()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    out = np.where(letter, points, 32).astype(np.uint32)
    body = out[letter | np.concatenate(([False], letter[:-1]))]
    body = body if letter[-1] else body[:-1]
    return np.concatenate((np.array([32], np.uint32), body, np.array([32], np.uint32)))


def gram_counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram stands in the whole text, as float32; zeros for a text without letters."""
    total = np.zeros(DIMENSIONS, np.int64)
    points = _letters(text or "").astype(np.uint64)
    for start in range(0, len(points), 1 << 20):  # a very long text piece by piece; pieces overlap by a gram
        part = points[start : start + (1 << 20) + max(SIZES) - 1]
        for n in SIZES:
            m = min(len(part) - n + 1, 1 << 20)
            if m > 0:
                code = np.zeros(m, np.uint64)
                for j in range(n):
                    code = code << np.uint64(21) | part[j : j + m]
                total += np.bincount((mix(code + np.uint64(n << 60)) >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return total.astype(np.float32)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows of n-gram counts; a row of zeros for a text without letters."""
    rows = np.log1p(counts) * idf
    norm = np.sqrt((rows**2).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _clusters(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means; starts are each the row farthest from those before."""
    start = [int(np.argmin(rows @ rows.mean(0)))]
    while len(start) < min(k, len(rows)):
        start.append(int(np.argmin((rows @ rows[start].T).max(1))))
    centres = rows[start].copy()
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (own == c).any():
                total = rows[own == c].sum(0)
                centres[c] = total / np.sqrt((total**2).sum())
    return centres


def _centroids(rows: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of clusters that hold ``SMALLEST`` of the rows; rows of smaller ones are left out and the others clustered again."""
    least = SMALLEST * len(rows)
    while True:
        centres = _clusters(rows, k)
        own = (rows @ centres.T).argmax(1)
        held = np.bincount(own, minlength=len(centres))
        large = held >= least
        if large.all() or not large.any():
            return centres
        rows = rows[large[own]]


class Model:
    """Learned inverse document frequencies, and per centroid its language, direction and lowest accepted cosines.

    ``least`` holds two per centroid: for texts of ``ENOUGH_GRAMS`` n-grams or more, and for shorter ones.
    """

    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.centres, self.least = idf, languages, centres, least

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """(language, cosine, rejected) per text; ``und``, 0 and rejected without a letter or a model."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        counts = np.stack([gram_counts(t) for t in texts]) if texts else np.zeros((0, DIMENSIONS), np.float32)
        rows = _vectors(counts, self.idf)
        short = (counts.sum(1) < ENOUGH_GRAMS).astype(int)
        cosine = rows @ self.centres.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(rows)), best], 0.0, 1.0).astype(float) if len(rows) else np.zeros(0)
        found = rows.any(1)
        names = [self.languages[b] if f else "und" for b, f in zip(best, found)]
        rejected = ~found | (score < self.least[best, short])
        return names, np.where(found, score, 0.0).tolist(), rejected.tolist()


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from ``labelled`` (doc_id, text, lang); rows without text or lang teach nothing.

    The model has one row of ``DIMENSIONS`` numbers per centroid and language; that, the document
    frequencies and the number of rows per language are all that reaches the driver.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                own = gram_counts(text.as_py()) > 0
                seen += own
                n += own.any()
        yield pa.RecordBatch.from_pydict({"gram": np.arange(-1, DIMENSIONS), "n": np.concatenate(([n], seen))})

    df = labelled.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    seen = {r.gram: r.n for r in df}
    idf = np.array([np.log((1 + seen.get(-1, 0)) / (1 + seen.get(g, 0))) + 1 for g in range(DIMENSIONS)], np.float32)

    # A little more than the bound is drawn by a hash of 64 bits, so that the exact bound is taken from few rows. They
    # travel as counts of one size, however long their texts are, and repeated rows as one.
    chance = F.xxhash64(F.col("doc_id").cast("string"), "text")
    limits = {lang: min((1 << 64) * (3 * sample + 100) // (2 * n) - (1 << 63), (1 << 63) - 1) for lang, n in counts.items()}
    limit = F.element_at(F.create_map(*[F.lit(x).cast(t) for lang, n in limits.items() for x, t in ((lang, "string"), (n, "long"))]), F.col("lang")) if limits else F.lit(0)
    drawn = labelled.filter(chance <= limit).select("lang", chance.alias("chance"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [gram_counts(text.as_py()).tobytes() for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.binary())], names=["lang", "chance", "grams"])

    drawn = drawn.mapInArrow(freed(count), "lang string, chance long, grams binary").groupBy("lang", "chance").agg(F.min("grams").alias("grams"))

    def per_language(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chance").head(sample)
        rows = np.stack([np.frombuffer(x, np.float32) for x in group["grams"]])
        grams = rows.sum(1)
        rows, grams = rows[grams > 0], grams[grams > 0]
        if not len(rows):
            return pd.DataFrame({"lang": [], "least": [], "centre": []})
        rows = _vectors(rows, idf)
        enough = grams >= ENOUGH_GRAMS
        centres = _centroids(rows[enough] if enough.sum() >= centroids else rows, centroids)
        cosine = rows @ centres.T
        best, top = cosine.argmax(1), cosine.max(1)
        tail = lambda x: REJECT_SHARE * float(np.quantile(x, REJECT_TAIL)) if len(x) else 0.0
        # A short text is far from every centroid, so short texts are measured with the lowest of their own kind.
        short = REJECT_SHORT * float(top[~enough].min() if (~enough).any() else top.min())
        least = [[tail(top[enough & (best == c)]), short] for c in range(len(centres))]
        return pd.DataFrame({"lang": group["lang"].iloc[0], "least": least, "centre": list(centres.astype(np.float32))})

    learned = drawn.groupBy("lang").applyInPandas(per_language, "lang string, least array<double>, centre array<float>").collect()
    learned.sort(key=lambda r: (r.lang, r.centre))
    centres = np.array([r.centre for r in learned], np.float32).reshape(len(learned), DIMENSIONS)
    return Model(idf, [r.lang for r in learned], centres, np.array([r.least for r in learned]).reshape(len(learned), 2))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string, score double and rejected boolean; columns of these names are replaced.

    A null text or one without a letter gives ``und``, 0.0 and true. Ties go to the language first in order.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.languages, model.centres, model.least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                names, score, rejected = own.predict(column.slice(start, 512).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*part.schema.names, "lang_pred", "score", "rejected"],
                )

    added = {"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}
    return docs.mapInArrow(freed(run), docs.select("*", *[F.nullif(v, v).alias(k) for k, v in added.items()]).schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
