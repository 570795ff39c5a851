import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import components, prose
from roadfuse.llm import decontaminate, jaccard, langid, licenses, linededup

SCHEMA = "doc_id long, text string, {} string, lang string"


def docs_of(spark, rows, extra="note"):
    return spark.createDataFrame([(i, t, "x", "en") for i, t in rows], SCHEMA.format(extra)).repartition(4)


# Line dedup


def repeated_lines(rows, least):
    """(lines, deleted lines, kept text) per row, by comparing every run of lines of ``least`` words or more with all earlier ones."""
    seen, out = {}, {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        if key[1] is None:
            out[key] = (0, 0, None)
            continue
        lines = key[1].split("\n")
        upto = [0]
        for x in lines:
            upto.append(upto[-1] + len([w for w in x.split(" ") if w]))
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if upto[j] - upto[i] >= least:
                    first = seen.setdefault(tuple(lines[i:j]), (key, j))
                    if first[0] != key or i >= first[1]:
                        gone.update(range(i, j))
        out[key] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_is_exact(spark):
    rng = random.Random(1)
    passages = ["\n".join(prose(rng, rng.randint(1, 9)) for _ in range(rng.randint(3, 9))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 6))]
        rows.append((i if i != 40 else None, "\n".join(parts)))
    rows += [(3, rows[3][1]), (500, None), (501, ""), (502, "\n".join(["a b c d e"] * 40)), (503, "\n" * 50), (504, " ".join(["w"] * 90))]
    rows += [(505, " ".join(["w"] * 90)), (506, "\n".join(f"line {i % 70} of a long text" for i in range(250)))]
    out = linededup.delete_repeated_lines(docs_of(spark, rows, "n_lines").withColumnsRenamed({"lang": "_hash"}).withColumns({c: F.lit(c) for c in ("_doc", "_doc_hash", "_spans", "__hash")}), 15).collect()
    want = repeated_lines(rows, 15)
    names = {(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in out}
    assert names == {(k[0], *v) for k, v in want.items()}
    assert len(out) == len(rows)
    assert {(r["_hash"], r["_doc"], r["_doc_hash"], r["_spans"], r["__hash"]) for r in out} == {("en", "_doc", "_doc_hash", "_spans", "__hash")}


def test_places_of_lines_are_not_bounded():
    """A line far behind in a text has the same fingerprint as at its top."""
    text = " ".join(f"w{i}" for i in range(60)).encode()
    marks = []
    for empty in (10, (1 << 24) + 5):
        raw = np.frombuffer(b"\n" * empty + text, np.uint8)
        _, first, end, key, line, _ = linededup.windows(raw, np.array([0, len(raw)]), 50)
        marks.append({(int(k), int(h)) for k, h, a, b in zip(key, line, first, end) if b - a == 1})
    assert marks[0] == marks[1] and len(marks[0]) == 1


def test_line_dedup_of_whole_runs(spark):
    rng = random.Random(5)
    blocks = ["\n".join(prose(rng, rng.choice([0, 1, 3, 8, 20])) for _ in range(rng.randint(2, 8))) for _ in range(10)]
    rows = [(i, "\n".join(rng.choice(blocks) if rng.random() < 0.6 else prose(rng, rng.randint(0, 12)) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    rows += [(502, "\n".join(["a b c d e"] * 40)), (503, "\n" * 50), (504, "x\n" + prose(rng, 9) + "\n\n\n" + "y\n" * 20)]
    out = linededup.delete_repeated_lines(docs_of(spark, rows), 15).collect()
    assert {(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in out} == {(k[0], *v) for k, v in repeated_lines(rows, 15).items()}
    # A line behind the last full window of a run, and lines without words on both sides of it.
    long, more, short = prose(rng, 60), prose(rng, 60), prose(rng, 10)
    rows = [(1, f"{long}\n{more}\n{short}"), (2, f"{long}\n{more}\n{short}"), (3, f"own\n{more}\n{short}\nown"), (4, f"a\n\n{long}\n\nb"), (5, f"c\n\n{long}\n\nd")]
    out = linededup.delete_repeated_lines(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "", 3: "own\nown", 4: "a\n\n\nb", 5: "c\nd"}


def test_line_dedup_of_nothing(spark):
    assert linededup.delete_repeated_lines(docs_of(spark, [])).count() == 0


# Jaccard join


def near_copies(rng, n=140):
    base = [prose(rng, rng.choice([5, 12, 40, 120])) for _ in range(12)]
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        text = " ".join(w)
        if rng.random() < 0.3:
            text = f"{passage} {text}"
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One TWO"), (905, "one two three"), (906, "é\x1cz É")]


@pytest.mark.parametrize("frequent", [2, 6, 24])
def test_jaccard_components_are_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(jaccard, "CROWD", 5 if frequent == 6 else 32)
    rows = near_copies(random.Random(frequent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs_of(spark, rows)).collect()}
    assert got == components(dict(rows))


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    bits = np.packbits(rng.random(1 << 12) < 0.5, bitorder="little")
    every = np.full(1 << 9, 255, np.uint8)
    for n in [2, 3, 4, 5, 7, 11, 16, 31, 64, 127, 200, 1000]:
        for bitmap in (bits, every):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            m = max(1, -(-75 * n // 100))
            y = np.unique(np.concatenate((rng.permutation(x)[: max(m, int(n * 0.86))], rng.integers(0, 2**64, int(n * 0.13), dtype=np.uint64))))
            common = len(np.intersect1d(x, y))
            if 100 * common >= 75 * (len(x) + len(y) - common):
                a = jaccard.signatures(x, bitmap, every, 75)
                b = jaccard.signatures(y, bitmap, every, 75)
                assert len(np.intersect1d(a, b)), n


def test_jaccard_repeated_and_null_ids(spark):
    text = prose(random.Random(2), 30)
    out = jaccard.link_components(docs_of(spark, [(None, text), (4, text), (4, text), (9, text)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in out) == [("4", "4"), ("4", "4"), ("9", "4"), ("None", "None")]
    assert jaccard.link_components(docs_of(spark, [])).count() == 0


# Decontamination


def edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_passages_within_the_budget_are_found(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([2, 12, 25]))) for i in range(12)] + [(50, None), (51, "  ...  "), (None, prose(rng, 20)), (52, "ab cd")]
    rows = []
    for i in range(50):
        letters = list(rng.choice(items[:12])[1])
        for _ in range(rng.choice([0, 0, 1, 3, 6, 12])):
            p = rng.randrange(len(letters))
            letters[p : p + 1] = rng.choice(["", "x", "qz", letters[p] + "k"])
        rows.append((i, f"{prose(rng, 20)} ,, {''.join(letters).title()}! {prose(rng, 20)}"))
    rows += [(90, None), (91, ""), (92, f"AB  cd {items[14][1]}"), (None, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_passages(docs_of(spark, rows, "matches"), benchmark).collect()
    got = {(r.doc_id, r.text): {(m.item_id, m.edits) for m in r.matches} for r in out}
    text_of = lambda x: "".join(map(chr, decontaminate.normal(x)))
    for doc_id, text in rows:
        t, want = text_of(text), set()
        for item, own in items:
            p = text_of(own)
            e = decontaminate.budget(len(p), decontaminate.Q, decontaminate.EDITS)
            if e >= 0 and (d := edits(p, t)) <= e:
                want.add((item, d))
            elif e < 0 and p and f" {p} " in f" {t} ":
                want.add((item, 0))
        assert got[doc_id, text] == want, (doc_id, want, got[doc_id, text])


def test_repeated_q_grams_match_brute_force():
    rng = random.Random(11)
    items = [
        (1, "1 " * 60), (2, "ab " * 30 + prose(rng, 12)), (3, prose(rng, 6) + " xyz" * 20 + " " + prose(rng, 6)), (4, "na" * 40), (5, prose(rng, 14)),
        (6, "the end of the day " * 5),
    ]
    own = decontaminate.Passages(items, decontaminate.Q, decontaminate.EDITS)
    assert own.loose.any() and not own.loose.all()
    as_text = lambda x: "".join(map(chr, decontaminate.normal(x)))

    def broken(text, n):
        for _ in range(n):
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", "q", text[i] + "w"]) + text[i + 1 :]
        return text

    texts = ["1 " * 300, "ab " * 200, "na" * 30, "na" * 300, "the end of the day " * 9, "xyz " * 99, "1 2 " * 100, "a " * 200]
    for _, t in items:
        texts += [f"{prose(rng, 8)} {broken(t, n)} {prose(rng, 8)}" for n in (0, 1, 3, 5, 9)] + [f"{t} {broken(t, 4)}", "1 " * 40 + t, t[: len(t) * 2 // 3]]
    for text in texts:
        want = set()
        for item, passage in items:
            p = as_text(passage)
            if (d := edits(p, as_text(text))) <= decontaminate.budget(len(p), decontaminate.Q, decontaminate.EDITS):
                want.add((item, d))
        assert {(m["item_id"], m["edits"]) for m in own.search(text)} == want, text


def test_repeats_in_passage_and_text_cost_no_product():
    own = decontaminate.Passages([(1, "1 " * 500), (2, "so on and " * 80)], decontaminate.Q, decontaminate.EDITS)
    # The entries are one per text place and passage, and what they give is aligned as one band.
    for text, item in (("1 " * 20_000, 1), ("so on and " * 20_000, 2)):
        assert [(m["item_id"], m["edits"]) for m in own.search(text)] == [(item, 0)]
    assert own.count.sum() < 20


def test_benchmark_in_blocks_and_long_documents(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 20)) for i in range(30)]
    rows = [(i, f"{prose(rng, 5)} {t}") for i, t in items] + [(99, prose(rng, 250_000) + " " + items[3][1] + " " + prose(rng, 100))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, tuple(r.matches)) for r in decontaminate.find_passages(docs_of(spark, rows), benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    blocks = {(r.doc_id, tuple(r.matches)) for r in decontaminate.find_passages(docs_of(spark, rows), benchmark).collect()}
    assert whole == blocks and all(len(m) == 1 for _, m in whole)
    assert decontaminate.clean(docs_of(spark, [*rows, (7777, "clean")]), benchmark).select("doc_id").collect()[0].doc_id == 7777
    assert decontaminate.find_passages(docs_of(spark, []), benchmark).count() == 0
    assert decontaminate.clean(docs_of(spark, rows), benchmark.limit(0)).count() == len(rows)


# Language identification


def corpus(rng, n=160):
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "éèçàù"}
    return [(i, prose(rng, rng.choice([3, 40, 200]), kinds[k]), "x", k) for i in range(n) for k in [sorted(kinds)[i % 3]]]


def test_language_of_held_out_documents(spark):
    rows = corpus(random.Random(9)) + [(900, None, "x", "xx"), (901, "12 !!", "x", "yy"), (902, "", "x", None), (None, "abc dea", "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA.format("score")).withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("not held_out"), sample=40, centroids=2)
    out = langid.identify(docs, model).collect()
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 20 and all(r.lang_pred == r.lang for r in held)
    assert {r.lang_pred for r in out if r.doc_id in (900, 901, 902)} == {"und"}
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows)
    assert not any(r.rejected for r in out if r.lang_pred != "und")
    foreign = spark.createDataFrame([(1, prose(random.Random(1), 300, "日本語中文字"))], "doc_id long, text string")
    assert langid.identify(foreign, model).first().rejected


def test_language_equals_brute_force(spark):
    """Counts, vectors and the nearest of all centroids, with plain Python numbers."""
    model = langid.fit(spark.createDataFrame(corpus(random.Random(4)), SCHEMA.format("x")), sample=40, centroids=3)

    def hashed(code):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 1)):
            code = (code ^ code >> shift) * factor % 2**64
        return code >> 52

    def counts(text):
        low = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
        points, out = [ord(c) for c in f" {low} "] if low else [], {}
        for n in langid.SIZES:
            for i in range(len(points) - n + 1):
                code = 0
                for p in points[i : i + n]:
                    code = code << 21 | p
                place = hashed((code + (n << 60)) % 2**64)
                out[place] = out.get(place, 0) + 1
        return out

    rng = random.Random(5)
    texts = [prose(rng, rng.choice([1, 5, 90]), letters) for letters in ("abcde", "fghij", "éèçàù", "abcfgh", "ÀÉx-1", "хцч") for _ in range(8)]
    texts += [None, "", "12 ..", "a", "É\x00é", "x" * 3000]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = counts(texts[r.doc_id])
        assert {i: int(n) for i, n in enumerate(langid.gram_counts(texts[r.doc_id])) if n} == own
        vector = {i: np.log1p(n) * model.idf[i] for i, n in own.items()}
        norm = sum(x * x for x in vector.values()) ** 0.5
        cosine = [sum(x * float(c[i]) for i, x in vector.items()) / norm if norm else 0.0 for c in model.centres]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        if not own:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        assert abs(r.score - cosine[best]) < 1e-4
        near = {model.languages[i] for i, c in enumerate(cosine) if c > cosine[best] - 1e-4}
        assert r.lang_pred in near
        least = model.least[best][int(sum(own.values()) < langid.ENOUGH_GRAMS)]
        assert r.rejected == (cosine[best] < least) or abs(cosine[best] - least) < 1e-4


def test_language_of_mislabelled_and_foreign_documents(spark):
    """A few mislabelled texts own no centroid, and a text of another language is refused although it shares letters."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 60, "abcde"), "x", "xx") for i in range(200)] + [(300, prose(rng, 60, "хцчшщ"), "x", "xx"), (301, prose(rng, 60, "хцчшщ"), "x", "xx")]
    model = langid.fit(spark.createDataFrame(rows * 2, SCHEMA.format("x")))
    texts = [prose(rng, 80, "хцчшщ"), prose(rng, 80, "aeghklmnoprs"), prose(rng, 80, "abcde"), "cab"]
    out = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.rejected for r in out] == [True, True, False, False]


def test_language_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA.format("x"))
    model = langid.fit(empty)
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_held_out_is_the_crc(spark):
    import zlib

    rows = spark.range(50).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


# Licences


def contained(text, template):
    import re

    w = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
    grams = lambda x: [tuple(x[i : i + 3]) for i in range(len(x) - 2)]
    own, t = grams(w(text)), set(grams(w(template)))
    step = max(1, len(t) // 8)
    return max([len(t & set(own[i : i + len(t) + 2 * step])) / len(t) for i in range(max(1, len(own)))], default=0)


def test_licences_against_all_windows(spark):
    rng = random.Random(11)
    rows = []
    for i, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = text.split()
        few = [x for x in w if rng.random() > 0.02]
        half = w[: len(w) // 2]
        rows += [(3 * i, f"{prose(rng, 200)} {' '.join(w)} {prose(rng, 50)}"), (3 * i + 1, " ".join(few).upper()), (3 * i + 2, f"{' '.join(half)} {prose(rng, 90)}")]
    rows += [(900, None), (901, ""), (902, "All"), (903, prose(rng, 30_000) + " All rights reserved.")]
    out = {r.doc_id: {x.license for x in r.licenses} for r in licenses.find_licenses(docs_of(spark, rows, "licenses")).collect()}
    for doc_id, text in rows:
        shares = {n: contained(text or "", t) for n, t in licenses.TEMPLATES.items()}
        # Starts of windows are an eighth of a template apart: what is clearly above the share is found, nothing below it is.
        assert {n for n, s in shares.items() if s >= 0.9} <= out[doc_id] <= {n for n, s in shares.items() if s >= 0.8}, doc_id
    assert licenses.find_licenses(docs_of(spark, [])).count() == 0


def test_licence_lines_that_documents_hold(spark, tmp_path):
    from roadfuse.llm.queries import op9_license_scan

    rng = random.Random(14)
    lines = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0-short",  # this and the next four stand in sf0.1
        "All rights reserved.": "all-rights-reserved",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0-notice",
        "Released under the MIT License.": "mit-notice",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0-notice",
        "CC-BY-NC-SA-3.0": "cc-by-nc-sa-3.0-short",
        "CC BY 4.0": "cc-by-4.0-short",
        "See https://creativecommons.org/licenses/by-nd/4.0/legalcode": "cc-by-nd-4.0-address",
        "a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License": "cc-by-nc-nd-3.0-long-2",
        "the Creative Commons Attribution-NonCommercial licence": "cc-nc-long",
        "Licensed under CC BY-NC.": "cc-nc-short",
        "CC0 1.0 Universal": "cc0-1.0-short",
        "This package is licensed under the GNU Lesser General Public License v3": "lgpl-notice",
        "It is licensed under the GNU Affero General Public License.": "agpl-notice",
    }
    rows = [(i, f"{prose(rng, 80)}\n{line}\n{prose(rng, 40)}") for i, line in enumerate(lines)] + [(99, prose(rng, 200))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op9_license_scan(spark, str(tmp_path)).collect()}
    for i, (line, name) in enumerate(lines.items()):
        assert name in out[i].licenses.split(","), line
    assert out[99].n_licenses == 0
    # Another member of the family is not reported, but for the non-commercial notice that its name holds.
    assert set(out[5].licenses.split(",")) == {"cc-by-nc-sa-3.0-short", "cc-nc-short"}
    assert out[6].licenses == "cc-by-4.0-short" and out[4].licenses == "gpl-3.0-notice"
