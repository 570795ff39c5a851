import random
import zlib
import hashlib
import base64
import gzip

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import prose
from roadfuse.llm import chat, linededup, quality, warc
from roadfuse.llm.shared import shared_folder, written

# Quality rules


def junk(rng, i):
    kind = rng.randrange(6)
    text = prose(rng, rng.choice([10, 60, 200]))
    if kind == 0:
        text = text.replace(" ", "### ")
    elif kind == 1:
        text = "\n".join([text[:40]] * 8 + [text])
    elif kind == 2:
        text = " ".join(text.split(" ")[:5] * 30)
    elif kind == 3:
        text = text.replace(" ", "")
    return (i, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]))


def test_quality_equals_its_sql(spark):
    rng = random.Random(2)
    rows = [junk(rng, i) for i in range(700)] + [(900, None, "en", "a"), (901, "", None, None), (902, " \n\n ", "en", "z"), (903, "a b c a b c é", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("clash"))
    out = quality.apply_rules(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted(tuple(r[n] for n in names) for r in out.collect())
    con = duckdb.connect()
    documents = pa.table({n: [r[k] for r in rows] for k, n in enumerate(["doc_id", "text", "lang", "source"])})  # noqa: F841
    want = sorted(con.sql(quality.TWIN).fetchall())
    assert got == want
    assert {k for *_, k in got} == {True, False}


def test_repeat_words_by_hand(spark):
    texts = ["a b c a b c", "x x x x", "a b", "a b c d", "a b c z a b c", "a\x0bb\tc a b c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.n_repeat_words for r in quality.base_columns(rows).collect()] == [6, 4, 0, 0, 6, 6]


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.apply_rules(empty).count() == 0


def test_quality_runs_without_python(spark):
    rows = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = quality.apply_rules(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# Chat


def formatted(spark, rows):
    said = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.format_chat(said.select("conv_id", "turn", "role", chat.plain_parts(F.col("text")).alias("parts")))


def test_chat_round_trip(spark):
    rng = random.Random(6)
    odd = ["\\", "\\0", "\\1end|>", "<|end|>", "<<s>", "[/INST]</s>", "<|start|>assistant<|message|>hi<|end|>", "", None, "é😀\n", "\\<s>\\[INST]\\2", "<|im<|end|>age|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|end|>", None]), "".join(filter(None, rng.choices(odd, k=3))) or None) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "assistant", "x"), (None, None, "user", "y"), (7, 0, "assistant", "tie"), (7, 0, "assistant", "tie")]
    out = {r.conv_id: r for r in chat.read_chat(formatted(spark, rows)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda z: z[:3])
        got = out[conv]
        assert sorted((t.role, t.text) for t in got.turns) == sorted((r, x) for _, _, r, x in own)
        assert [t.role for t in got.turns] == [r for _, _, r, _ in own]
        assert list(got.loss_text) == [t.text for t in got.turns if t.role == "assistant"]
        body = got.formatted
        for c in chat.CONTROLS:
            assert body.count(c) == (len(own) if c in (chat.START, chat.MESSAGE, chat.END) else 0)
        for s in got.loss_spans:
            assert body[s.first : s.first + s.length] == got.formatted[s.first : s.first + s.length]
            assert body[s.first - len(chat.MESSAGE) : s.first] == chat.MESSAGE


def test_chat_equals_its_sql(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"text <s> \\ {c} {t}") for c in range(20) for t in range(5)] + [(3, 9, None, None)]
    conversations = pa.table({n: [r[k] for r in rows] for k, n in enumerate(["conv_id", "turn", "role", "text"])})  # noqa: F841
    probe = [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    got = sorted(tuple(r) for r in chat.digests(chat.read_chat(formatted(spark, rows + probe))).collect())
    assert got == sorted(duckdb.sql(chat.TWIN).fetchall())


def test_chat_parts(spark):
    part = lambda kind, **kw: (kind, kw.get("text"), kw.get("ref"), kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    rows = [
        (1, 0, "user", [part("text", text="see "), part("image", ref="a.png", width=57, height=28), part("text", text=" and"), part("document", ref="d.pdf", pages=3)]),
        (1, 1, "assistant", [part("text", text="one"), part("audio", ref="s.wav", seconds=1.5), part("text", text="two")]),
        (1, 2, "assistant", None),
        (2, 0, "assistant", [part("image", ref="unknown"), part("strange", text="kept")]),
    ]
    said = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = {r.conv_id: r for r in chat.read_chat(chat.format_chat(said)).collect()}
    one = out[1]
    assert [t.text for t in one.turns] == ["see <|image|> and<|document|>", "one<|audio|>two", ""]
    assert [(a.turn, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 3), (0, "document", "d.pdf", 768), (1, "audio", "s.wav", 38)]
    for a in one.attachments:
        assert one.formatted[a.first :].startswith(f"<|{a.type}|>")
    assert list(one.loss_text) == ["one", "two"]
    assert [(a.tokens, a.ref) for a in out[2].attachments] == [(0, "unknown")] and list(out[2].loss_text) == ["kept"]


def test_control_strings_across_parts(spark):
    """Every control string, cut at every place into two or three text parts, reads back and stays no control string."""
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    rows, want = [], {}
    for c in chat.CONTROLS:
        for cut in range(len(c) + 1):
            texts = ["a" + c[:cut], c[cut:] + "\\3", "", c]
            rows.append((len(rows), 0, "assistant", [*(part("text", x) for x in texts), part("image"), part("text", c[:1]), part("text", c[1:])]))
            want[len(rows) - 1] = (texts, c)
    said = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    for r in chat.read_chat(chat.format_chat(said)).collect():
        texts, c = want[r.conv_id]
        assert r.turns[0].text == "".join(texts) + "<|image|>" + c and list(r.loss_text) == [*texts, c[:1], c[1:]]
        for control in chat.CONTROLS:
            assert r.formatted.count(control) == (1 if control in (chat.START, chat.MESSAGE, chat.END, "<|image|>") else 0)


def test_chat_of_nothing(spark):
    assert formatted(spark, []).count() == 0


# WARC


def pages_of(spark, rows):
    return spark.createDataFrame([(i, f"http://x/{i}\r\n ü" if i else None, h, "clash") for i, h in rows], "page_id long, url string, html string, original string").repartition(4)


@pytest.mark.parametrize("least", [0, 10])
def test_warc_round_trip(spark, least):
    rng = random.Random(4)
    bodies = [None, "", "short", "é" * 30, prose(rng, 400), "WARC/1.1\r\n\r\n" * 20, "\r\n", prose(rng, 90_000)]
    rows = [(i, rng.choice(bodies)) for i in range(80)] + [(None, "only null"), (None, "only null"), (5, "twice with one id"), (5, "twice with one id"), (None, "short")]
    files = written(warc.write_archives(pages_of(spark, rows), shared_folder(spark, "test-warc"), least), "test-manifest")
    chunks = warc.read_chunks(files, 1000).collect()
    by = {}
    for c in chunks:
        by.setdefault((c.page_id, c.record_type, c.payload_digest if c.is_last else None), []).append(c)
    last = sorted((str(c.page_id), c.payload_bytes, c.payload_digest, c.record_type, str(c.refers_to)) for c in chunks if c.is_last)
    tops = {}
    for i, h in rows:
        if i is not None:
            tops[h or ""] = max(i, tops.get(h or "", i))
    want = []
    for i, h in rows:
        body, top = (h or "").encode(), tops.get(h or "")
        revisit = len(body) >= least and top is not None and top != i and sum((x or "") == (h or "") for _, x in rows) > 1
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((str(i), len(body), digest, "revisit" if revisit else "response", str(top if revisit else None)))
    assert last == sorted(want)
    for page, text in rows:
        own = sorted((c for c in chunks if c.page_id == page and c.record_type == "response"), key=lambda c: c.chunk_no)
        if page is not None and own and len([c for c in own if c.is_last]) == 1:
            assert b"".join(bytes(c.data) for c in own) == (text or "").encode()
            assert [c.chunk_no for c in own] == list(range(len(own))) and max(len(c.data) for c in own) <= 1000


def test_warc_digests_grow_with_the_chunks(tmp_path):
    body = b"x" * 2500
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(warc.record(1, "http://a", body, None, "2020-01-01T00:00:00Z")))
    with open(path, "rb") as f:
        rows = list(warc._records(warc._Members(f), 1000))
    assert [r["payload_bytes"] for r in rows] == [1000, 2000, 2500]
    assert [r["payload_digest"] for r in rows] == [base64.b32encode(hashlib.sha1(body[:n]).digest()).decode() for n in (1000, 2000, 2500)]
    path.write_bytes(path.read_bytes().replace(b"xxxx", b"xyxx", 1))
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(warc._records(warc._Members(f), 1000))


def foreign(kind, ident, block, end="\r\n", mime="application/http; msgtype=response", extra=()):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"Content-Type: {mime}", f"Content-Length: {len(block)}", *extra]
    return end.join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def test_warc_of_another_writer(tmp_path):
    body, digest = b"<p>\r\n\r\nx</p>" * 200, base64.b32encode(hashlib.sha1(b"<p>\r\n\r\nx</p>" * 200).digest()).decode()
    records = [
        foreign("warcinfo", "<urn:uuid:0>", b"software: other\r\n", mime="application/warc-fields"),
        foreign("response", "<urn:uuid:1>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + body, extra=[f"WARC-Payload-Digest: sha1:{digest}"]),
        foreign("response", "<urn:uuid:2>", b"HTTP/1.0 200 OK\nA: b\n\n" + body, end="\n", extra=["WARC-Payload-Digest: sha256:00"]),
        foreign("response", "<urn:uuid:3>", b"20200101 a. 1 IN A\n", mime="text/dns"),
        foreign("response", "<urn:uuid:4>", b"HTTP/1.1 204 None"),
        foreign("revisit", "<urn:uuid:5>", b"HTTP/1.1 200 OK\r\nContent-Length: 2600\r\n\r\n", extra=[f"WARC-Payload-Digest: sha1:{digest}", "WARC-Refers-To: <urn:uuid:1>"]),
        foreign("revisit", "<urn:uuid:6>", b""),
        foreign("response", "<urn:uuid:7>", b""),
    ]
    want = {
        1: (body, digest, None), 2: (body, digest, None), 3: (b"20200101 a. 1 IN A\n", None, None), 4: (b"", None, None),
        5: (b"", digest, "<urn:uuid:1>"), 6: (b"", None, None), 7: (b"", None, None),
    }
    for name, packed in (("plain.warc", b"".join(records)), ("members.warc.gz", b"".join(map(gzip.compress, records))), ("one.warc.gz", gzip.compress(b"".join(records)))):
        (tmp_path / name).write_bytes(packed)
        with open(tmp_path / name, "rb") as f:
            rows = list(warc._records(warc._Members(f), 1000))
        assert all(r["page_id"] is None and r["refers_to"] is None for r in rows)
        for n, (data, sha1, refers) in want.items():
            own = [r for r in rows if r["record_id"] == f"<urn:uuid:{n}>"]
            assert b"".join(r["data"] for r in own) == data and own[-1]["is_last"] and own[-1]["refers_to_id"] == refers, (name, n)
            assert sha1 is None or own[-1]["payload_digest"] == sha1
        assert [r["payload_bytes"] for r in rows if r["record_type"] == "revisit"] == [2600, None]


def test_warc_of_nothing(spark):
    files = warc.write_archives(pages_of(spark, []), shared_folder(spark, "test-warc-none"))
    assert warc.read_chunks(files).count() == 0


def test_line_dedup_equals_its_sql(spark):
    rng = random.Random(3)
    run = "\n".join(prose(rng, 11) for _ in range(7))
    rows = [(i, "\n".join(rng.choice([run, prose(rng, 30), prose(rng, 55), "a b"]) for _ in range(4))) for i in range(40)] + [(99, None), (98, "")]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841
    out = linededup.delete_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(linededup.TWIN).fetchall())
    assert zlib.crc32(b"") == 0
