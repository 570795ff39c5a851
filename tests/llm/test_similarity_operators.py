import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import components, prose
from roadfuse.llm import hardneg, minhash, spelling

# Near duplicates


def changed(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1, "xyz")
    return " ".join(words)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(31)
    texts = {}
    for base in range(12):
        text = prose(rng, rng.choice([4, 7, 30, 120, 400]))
        for copy in range(rng.randint(1, 9)):
            texts[base * 10 + copy] = changed(rng, text, copy % 4)
    chain = prose(rng, 100).split(" ")
    for step in range(12):  # each text is near the next one only
        texts[200 + step] = " ".join(chain[step * 4 : step * 4 + 55])
    texts |= {300: None, 301: "", 302: " \n\t", 303: "One TWO", 304: "one\ntwo", 305: "w " * 3000, 306: "w " * 9, 307: texts[0].upper()}
    rows = [(t, i, "x") for i, t in texts.items()] + [(texts[3 * 10], 30, "x"), (None, None, "x"), (texts[0], None, "x")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, key string").withColumn("low", F.lit(1)).repartition(5)
    out = minhash.near_duplicates(docs).collect()
    want = components(texts, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None} == {(i, *v) for i, v in want.items()}
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in out)


def test_pairs_beyond_a_bucket_s_centre_are_found(spark):
    rng = random.Random(5)
    base = prose(rng, 300).split(" ")
    left, right = list(base), list(base)
    for i in range(0, 40, 8):
        left[i] = right[i] = prose(rng, 1, "xyz")
    for i in range(100, 300, 40):
        left[i] = prose(rng, 1, "uvw")
    texts = {1: " ".join(base)} | {i: " ".join(changed(rng, " ".join(right if i % 2 else left), 3).split(" ")) for i in range(2, 40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert out == components(texts, 85)


def test_signatures_agree_as_sets_do(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 5000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = a[: max(1, int(n * 0.9))]
        agree = (minhash.signature(a) == minhash.signature(b)).mean()
        assert abs(agree - len(b) / len(a)) < 0.15
        assert (minhash.signature(a) == minhash.signature(a.copy())).all()
    assert len(minhash.bands(minhash.signature(a))) == minhash.BINS // minhash.ROWS


def test_blocks_of_a_torn_bucket_meet(spark, monkeypatch):
    """In blocks of three rows every two components that are similar are still joined, each by one link of a task."""
    monkeypatch.setattr(minhash, "BLOCK", 3)
    signs = [bytes([kind + 1] * minhash.BINS) for kind in range(3)]
    keys = [[7] + [8 + kind * 100 + b for b in range(31)] for kind in range(3)]
    members = spark.createDataFrame([(7, i, 10) for i in range(1, 31)], "key long, doc_id long, n int")
    sign = spark.createDataFrame([(i, bytearray(signs[i % 3]), keys[i % 3]) for i in range(1, 31)], "doc_id long, marks binary, bands array<long>")
    component = spark.createDataFrame([(i, 100) for i in range(1, 16)], "doc_id long, c long")
    rows = minhash._torn(members, component)
    assert {r.lefts for r in rows.collect()} == {5} and {r.rights for r in rows.collect()} == {10}
    nearest = minhash._look_alike(rows, sign, 85, nearest=True).collect()
    assert {i for r in nearest for i in r if i > 15} == set(range(16, 31)) and all((r.a - r.b) % 3 == 0 for r in nearest)
    torn = minhash._look_alike(rows, sign, 85, nearest=False)
    assert {r.doc_id for r in torn.collect()} == set(range(1, 31))
    tokens = [np.arange(10, dtype="<u8") + 100 * kind for kind in range(3)]
    sets = spark.createDataFrame([(i, bytearray(tokens[i % 3].tobytes())) for i in range(1, 31)], "doc_id long, tokens binary")
    links = [(r.a, r.b) for r in minhash._links_across(torn, sets, 85).collect()]
    assert all((a - b) % 3 == 0 and b > 15 for a, b in links)
    for kind in range(3):
        part = {i: i if i > 15 else 100 for i in range(1, 31) if i % 3 == kind}
        for a, b in links:
            if a % 3 == kind:
                part = {i: part[a] if c == part[b] else c for i, c in part.items()}
        assert len(set(part.values())) == 1


# Hard negatives


def mined(rows, anchors, positives, negatives, low, high):
    out = set()
    for a, label, x in rows:
        if not anchors(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y)), i, m) for i, m, y in rows if i != a))
        for p, i in [(-s, i) for s, i, m in scored if m == label][:positives]:
            good = [(-s, j) for s, j, m in scored if m != label and low * p <= 100 * -s <= high * p]
            out |= {(a, i, rank, j, p, s) for rank, (s, j) in enumerate(good[:negatives], 1)}
    return out


@pytest.mark.parametrize("block", [16_384, 7])
def test_hard_negatives_against_all_scores(spark, block):
    rng = random.Random(3)
    centre = [[rng.randint(-9, 9) for _ in range(20)] for _ in range(4)]
    rows = [(i, i % 4, [c + rng.randint(-4, 4) for c in centre[rng.choice([i, i, i + 1]) % 4]]) for i in range(300)]
    rows[17] = (17, 1, rows[13][2])  # ties
    rows[21] = (21, 1, [0] * 20)
    broken = [(None, 1, [1] * 20), (500, None, [1] * 20), (501, 1, None), (502, 1, [1, None]), (510, 9, [5] * 20)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows + broken], "id long, label int, x array<long>, score string").repartition(3)
    out = hardneg.hard_negatives(vectors, F.col("id") % 10 == 0, positives=3, negatives=4, block=block)
    want = mined(rows + broken[4:], lambda i: i % 10 == 0, 3, 4, 30, 90)
    assert {tuple(r) for r in out.collect()} == want and len(want) > 100


def test_hard_negatives_of_few_rows(spark):
    schema = "id long, label int, x array<long>"
    none = hardneg.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 2 == 0)
    assert none.count() == 0 and none.columns[:3] == ["anchor_id", "positive_id", "rank"]
    alone = spark.createDataFrame([(2, 1, [3]), (3, 2, [3]), (5, 1, [-1])], schema)
    assert hardneg.hard_negatives(alone, F.col("id") == 2).count() == 0  # the only positive scores below zero
    few = spark.createDataFrame([(2, 1, [10]), (3, 2, [5]), (5, 1, [10]), (6, 3, [9])], schema)
    assert [tuple(r) for r in hardneg.hard_negatives(few, F.col("id") == 2).orderBy("rank").collect()] == [(2, 5, 1, 6, 100, 90), (2, 5, 2, 3, 100, 50)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.normal(size=(50, 30)))
    x[:25] = np.repeat(np.floor(100 * rng.normal(size=(25, 5))), 6, axis=1)
    columns = [np.arange(50), np.zeros(50), [r.tobytes() for r in x]]
    for s in hardneg.SEGMENTS:
        columns += [[r.tobytes() for r in part] for part in hardneg._summary(x, s)]
    rows = hardneg._Rows(columns, 0, 50)
    exact, widths = x @ x.T, []
    for level in range(len(hardneg.SEGMENTS)):
        lowest, highest = hardneg._bounds(rows, rows, level)
        assert (lowest <= exact).all() and (exact <= highest).all()
        widths.append((highest - lowest).mean())
    assert widths[1] < widths[0]


# Spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min((-counts[v], v) for v in near[w]) for w in counts if near[w]}
    form = {w: v for w, (n, v) in best.items() if -n >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, form.get(w), root(w), len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def test_variants_against_all_pairs(spark):
    rng = random.Random(6)
    words = set()
    for _ in range(60):
        w = "".join(rng.choice("abé") for _ in range(rng.choice([7, 8, 9, 12, 33, 40, 70])))
        words.add(w)
        for _ in range(4):
            at = rng.randrange(len(w))
            v = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abc") + w[at:], w[:at] + rng.choice("abcé") + w[at + 1 :]])
            words |= {v} if len(v) >= 7 else set()
            w = v if rng.random() < 0.5 and len(v) >= 7 else w
    words |= {"a" * k for k in range(7, 12)} | {"a" * 90, "a" * 91, "z" * 200, "z" * 199 + "y", "ÿ" * 8, "ÿ" * 7}
    counts = {w: rng.choice([2, 3, 25, 300, 4000, 50_000]) for w in words}
    out = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    got = {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in out.collect()}
    want = variants(counts)
    assert got == want and sum(r[4] for r in want) > 200 and any(r[2] and r[2] != r[3] for r in want)


def test_words_of_documents(spark):
    rng = random.Random(8)
    base = [prose(rng, 1, "abcdé").replace(" ", "") * 3 for _ in range(20)]
    texts = [(i, " ".join(rng.choice([str.upper, str, str.title])(rng.choice(base)) + rng.choice(["", "1", "×", "-b", "ÿ"]) for _ in range(200))) for i in range(30)]
    texts += [(None, "overflow overflow"), (40, None), (41, ""), (42, "Straßenbahn Ωοverflow " * 2), (40, "overflow"), (43, "lettersonly" * 200_000)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, n int").repartition(4)
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {r.word: r.n for r in spelling.word_counts(docs, slip_every=31).collect()} == want
    got = spelling.spelling_variants(docs, slip_every=31).collect()
    assert {(r.word, r.n, r.form, r.root, r.n_near, r.form_n) for r in got} == variants(want)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_PIECE", 10)
    text = "überall mehr als zehn buchstaben × und so weiter".encode()
    runs = [r for piece in spelling._pieces(text) for r in spelling._RUN.findall(piece)]
    assert runs == spelling._RUN.findall(text)


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
