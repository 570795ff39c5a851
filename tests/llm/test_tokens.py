import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import prose
import corpus_pipeline
from roadfuse.llm import bpe, tokenfile
from roadfuse.llm.chunks import ChunkEncoder, encoded
from roadfuse.llm.shared import file_system, shared_folder
from roadfuse.llm.wordhash import strings

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "  a  b ", "don't  stop", "th" * 4000, "日本語 テキスト　です\xa0x", "x\r\n y", "a  b à c « d »", "<|endoftext|> x", "a  <|endoftext|>  b c d", "x y<|endoftext|>z w", "a b <|endoftext|> c <|endoftext|><|endoftext|> d e", "\x00 \x1c y"]


def library(kind):
    if kind == "ranks":
        own = bpe.Ranks(RANKS)
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.rank, special_tokens={}).encode_ordinary
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return {"ranks": (bpe._encoder(RANKS, P.PATTERN), library("ranks")), "json": (tokenfile._encoder(JSON), library("json"))}


def ids_of(encoder, texts, size=1 << 20):
    import pyarrow as pa

    out = []
    for _, _, flat, counts in encoded(encoder, *strings(pa.array(texts, pa.string())), size):
        ends = np.cumsum(counts)
        out += [flat[e - c : e].tolist() for e, c in zip(ends, counts)]
    return out


@pytest.mark.parametrize("kind", ["ranks", "json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab 'sé\n\t  　12.!")), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=6))
def test_ids_are_the_libraries(encoders, kind, texts):
    encoder, reference = encoders[kind]
    assert ids_of(encoder, texts) == [reference(t) for t in texts]


@pytest.mark.parametrize("kind", ["ranks", "json"])
def test_odd_texts_and_small_slices(encoders, kind):
    encoder, reference = encoders[kind]
    rng = random.Random(3)
    texts = ODD + [prose(rng, 300, "thernoa") for _ in range(20)]
    assert ids_of(encoder, texts, 500) == [reference(t) for t in texts]


def test_a_full_memory_of_chunks_changes_nothing():
    reference = library("ranks")
    encoder = ChunkEncoder(bpe._chunk_ids(bpe.Ranks(RANKS), P.PATTERN), most=5)
    texts = [prose(random.Random(i), 50) for i in range(8)]
    assert ids_of(encoder, texts, 300) == [reference(t) for t in texts]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_encode_decode_rows(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "a b", None, None), (5, None, "x", 2), (5, None, "x", 2)]
    docs = documents(spark, rows).repartition(3)
    out = bpe.digests(bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)).collect()
    reference = library("ranks")
    want = sorted((str(i), t or "", n) for i, t, _, n in rows for n in [len(reference(t or ""))])
    assert sorted((str(r.doc_id), r.text or "", r.n_tokens) for r in out) == want
    for r in out:
        assert bytes(r.decoded) == (r.text or "").encode() and list(r.ids) == reference(r.text or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_round_trip_takes_one_worker_a_task(spark):
    docs = documents(spark, [(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "a b", None, None), (7, None, "", 0)])
    own, apart = bpe.round_trip(docs, RANKS, P.PATTERN), bpe.decode(bpe.encode(docs, RANKS, P.PATTERN).drop("text"), RANKS)
    assert own.schema == apart.schema and sorted(map(str, own.collect())) == sorted(map(str, apart.collect()))
    plan = corpus_pipeline.encode_tokens(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_encode_nothing(spark):
    assert bpe.decode(bpe.encode(documents(spark, []), RANKS, P.PATTERN), RANKS).count() == 0


def test_token_files(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 3, 80])), "x", 0) for i in range(60)] + [(None, "none", "", 0), (7, None, "", 0), (7, "again", "", 0)]
    rows.append((1000, prose(rng, 60_000), "long", 0))
    root = shared_folder(spark, "test-tokens")
    docs = documents(spark, rows).repartition(5)
    manifest = tokenfile.with_first(tokenfile.manifest_of(spark, tokenfile.write_tokens(docs, root, JSON, files=4)))
    reference = library("json")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    want, start = [], 0
    for doc_id, text, _, _ in order:
        ids = [*reference(text or ""), 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tokenfile.read_summaries(manifest).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == want
    some = {r.doc_id: list(r.ids) for r in tokenfile.read_documents(manifest, [3, 1000]).collect()}
    assert some == {d: [*reference(t), 0] for d, t, _, _ in rows if d in (3, 1000)}


def test_only_wanted_frames_are_unpacked_and_checked(tmp_path):
    path = str(tmp_path / "x.tokens")
    with open(path, "wb") as f:
        writer = tokenfile.TokenFileWriter(f, frame_tokens=100)
        for i in range(10):
            writer.add(i, np.arange(i * 70, i * 70 + 70))
        writer.close()
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255  # inside the first frame
    open(path, "wb").write(raw)
    system, local = file_system(path)
    with system.open_input_file(local) as f:
        reader = tokenfile.TokenFileReader(f, f.size())
        assert np.concatenate(list(reader.parts(8))).tolist() == list(range(560, 630))
        with pytest.raises(Exception):
            list(reader.parts(0))


def test_empty_token_files(spark):
    manifest = tokenfile.write_tokens(documents(spark, []), shared_folder(spark, "test-none"), JSON)
    assert tokenfile.read_summaries(tokenfile.with_first(manifest)).count() == 0
