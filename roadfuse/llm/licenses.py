"""Licence texts in documents: an exact scan for shingles, MinHash bands over windows, exact containment.

Words are runs of letters and digits in lower case; shingles have three words. For each template,
windows of its own number of shingles start at every eighth of it. The exact scan carries the
search: templates with less than ``CONTAINED`` of their shingles in the text, and windows without
any of them, are passed over. The other windows' MinHash bands must retrieve the template, which
can only take places away, and the text around such a window is accepted if it holds ``CONTAINED``
of the template's shingles. An edited notice stretched over 1.25 template lengths has a Jaccard
similarity of about 0.47, which 48 bands of 2 rows miss with a probability of about 6e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.license_texts import TEMPLATES
from roadfuse.llm.shared import remembered
from roadfuse.llm.wordhash import hash_spans, mix, pieces, shingles, strings, word_spans

_U = np.uint64
WORDS, BANDS, ROWS, CONTAINED = 3, 48, 2, 0.8
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOUND = "array<struct<license: string, contained: double, first_word: int, last_word: int>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("contained", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash at every word, row of every word); the last words of a row have meaningless hashes."""
    raw = _LOWER[raw]
    starts, ends, rows = word_spans(raw, offsets, _OUTSIDE)
    h = hash_spans(raw, starts, ends)
    own = shingles(h, WORDS)
    return np.concatenate((own, np.zeros(len(h) - len(own), _U))), rows


def band_keys(tokens: np.ndarray) -> np.ndarray:
    """One hash per band of the MinHash signature of a set of shingles."""
    least = mix(tokens * _SEEDS[:, None]).min(1).reshape(BANDS, ROWS)
    return mix(least[:, 0] * _U(0x9E3779B97F4A7C15) + least[:, 1] * _U(0xD6E8FEB86659FD93) + np.arange(BANDS, dtype=_U))


class Templates:
    def __init__(self, texts: dict[str, str]):
        self.names, self.sets = [], []
        for name, text in sorted(texts.items()):
            raw, offsets = strings(pa.array([text]))
            h, _ = _grams(raw, offsets)
            if len(h) >= WORDS:
                self.names.append(name)
                self.sets.append(np.unique(h[: len(h) - WORDS + 1]))
        self.all = np.unique(np.concatenate([*self.sets, np.zeros(0, _U)]))
        #: Which shingle of ``all`` stands in which template.
        self.owner = np.array([np.isin(self.all, own) for own in self.sets], bool).reshape(len(self.sets), len(self.all))
        self.sizes = np.array([len(own) for own in self.sets], np.int64)
        self.bands: dict[int, set[int]] = {}
        for t, own in enumerate(self.sets):
            for key in band_keys(own).tolist():
                self.bands.setdefault(key, set()).add(t)

    def search(self, h: np.ndarray) -> list[dict]:
        """The best place of every template in one text's shingles; ties: the first."""
        best: dict[int, tuple[float, int, int]] = {}
        known = np.flatnonzero(np.isin(h, self.all))
        present = np.searchsorted(self.all, np.unique(h[known]))
        for t in np.flatnonzero(self.owner[:, present].sum(1) >= CONTAINED * self.sizes).tolist():
            size = len(self.sets[t])
            hits = known[np.isin(h[known], self.sets[t])]
            step = max(1, size // 8)
            starts = np.unique(np.concatenate([(hits // step - k) * step for k in range(-(-size // step) + 1)]))
            starts = starts[(starts >= 0) & (starts < len(h))]
            for start in starts.tolist():
                window = h[start : start + size]
                inside = hits[np.searchsorted(hits, start) : np.searchsorted(hits, start + size)]
                if not len(inside) or t not in set().union(*(self.bands.get(k, ()) for k in band_keys(window).tolist())):
                    continue
                low, high = max(0, start - step), start + size + step
                near = hits[np.searchsorted(hits, low) : np.searchsorted(hits, high)]
                contained = len(np.unique(h[near])) / size
                if contained >= CONTAINED and (t not in best or contained > best[t][0]):
                    best[t] = (contained, int(near[0]), int(near[-1]) + WORDS)
        return [{"license": self.names[t], "contained": c, "first_word": a, "last_word": b} for t, (c, a, b) in sorted(best.items())]


def find_licenses(docs: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` (text, ...) with ``licenses``: template, share of its shingles, first word and end word.

    ``texts`` are the templates (a fixed list; they travel with the tasks); one of fewer than three
    words is left out. A null text holds none. A column named ``licenses`` is replaced. Documents
    are not shuffled.
    """
    docs = docs.drop("licenses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = remembered(("licences", *sorted(texts.items())), lambda: Templates(texts))
        for batch in batches:
            raw, offsets = strings(batch.column(batch.schema.get_field_index("text")))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for a, b in pieces(raw, offsets):
                h, rows = _grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.minimum(np.searchsorted(templates.all, h), max(0, len(templates.all) - 1))
                hit = rows[templates.all[at] == h] if len(templates.all) else rows[:0]
                bounds = np.searchsorted(rows, np.arange(b - a + 1))
                for row in np.unique(hit).tolist():
                    own = h[bounds[row] : max(bounds[row], bounds[row + 1] - WORDS + 1)]
                    found[a + row] = templates.search(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW)], names=[*batch.schema.names, "licenses"])

    return docs.mapInArrow(run, docs.select("*", F.array().cast(_FOUND).alias("licenses")).schema)
