import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from helpers import components, prose
from roadfuse.llm import bpe, decontaminate
from test_text_operators import edits, repeated_lines


@pytest.fixture
def folder(spark, tmp_path):
    """Documents with copies, shared passages and leaks, and the benchmark they leak from."""
    rng = random.Random(12)
    kinds = {"xx": "abcde", "yy": "fghij"}
    items = [(i, prose(rng, 25, "abcdefghij")) for i in range(5)]
    passage = "\n".join(prose(rng, 12, "abcde") for _ in range(6))
    rows = []
    for i in range(90):
        lang = "xy"[i % 2] * 2
        text = "\n".join(prose(rng, rng.randint(4, 14), kinds[lang]) for _ in range(rng.randint(1, 9)))
        if i % 9 == 0:
            text += "\n" + passage
        if i % 11 == 0:
            text = f"{text[:200]} {items[i % 5][1].title()}. {text[200:]}"
        if i % 7 == 3 and rows:
            words = rows[-2][1].replace("\n", " ").split(" ")
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200, None, "xx", "s", None), (201, "", None, None, 0), (202, "12 34", "xx", "s", 5), (203, rows[4][1], "xx", "t", 1), (None, prose(rng, 30, "abcde"), "xx", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_duplicates", "decontamination", "encode"]
    want = {(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "line_dedup":
            cut = repeated_lines(want, 50)
            want = {(k[0], v[2]) for k, v in cut.items() if not v[1] or v[2].strip()}
        elif name == "near_duplicates":
            linked = components({i: t for i, t in want if i is not None})
            want = {(i, t) for i, t in want if i is None or linked[i][1] == i}
        elif name == "decontamination":
            text_of = lambda x: "".join(map(chr, decontaminate.normal(x)))
            leaked = lambda t: any(
                edits(p, text_of(t)) <= decontaminate.budget(len(p), decontaminate.Q, decontaminate.EDITS) for p in (text_of(x) for _, x in items)
            )
            want = {(i, t) for i, t in want if not leaked(t)}
        out = stage(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert len(got) == len(set(got)) and set(got) == want, name
    assert docs.filter(F.col("n_chars") != F.char_length("text")).filter("doc_id < 90").count() == 0
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.Ranks(P.path("byte_bpe_multi_50k.tiktoken")).rank, special_tokens={})
    assert {(r.doc_id, tuple(r.ids), r.decoded_sha256) for r in encoded} == {
        (i, tuple(library.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in want
    }


def test_line_dedup_takes_whole_runs(spark):
    rng = random.Random(13)
    run = "\n".join(prose(rng, n) for n in (60, 60, 10))
    rows = [(1, run, "xx", "s", 1), (2, run, "xx", "s", 1), (3, f"own words\n{run}\nmore of them", "xx", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in out} == {(1, run), (3, "own words\nmore of them")}


def test_run_and_registration(spark, folder):
    path, rows, _ = folder
    out = entry.queries()["pipeline"](spark, path)
    assert 0 < out.count() < len(rows)
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
