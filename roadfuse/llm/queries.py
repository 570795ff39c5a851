"""The registered queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadfuse.llm import bpe, chat, decontaminate, hardneg, jaccard, langid, licenses, linededup, minhash, quality, spelling, tokenfile, warc
from roadfuse.llm.shared import shared_folder, small_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.apply_rules(docs, keep_measured=lambda df: written(df.drop("text"), "quality-measures"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    root = shared_folder(spark, "token-files")
    manifest = tokenfile.write_tokens(docs, root, _vocabulary("byte_bpe_50k.json"), end_id=0)
    manifest = tokenfile.with_first(tokenfile.manifest_of(spark, manifest))
    return tokenfile.read_summaries(manifest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = written(warc.write_archives(pages, shared_folder(spark, "warc-files"), least_bytes=0), "warc-manifest")
    # The last chunk of a record carries the size and the digest of all.
    return warc.read_chunks(files).filter("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark, 2 << 20)  # the operator works on no more at once
    return jaccard.link_components(docs)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.delete_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '{chat.PROBE}' AS text FROM range(2)")
    said = said.unionByName(probe)
    formatted = chat.format_chat(said.select("conv_id", "turn", "role", chat.plain_parts(F.col("text")).alias("parts")))
    return chat.digests(chat.read_chat(formatted))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = _vocabulary("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text"), path)
    return bpe.digests(tokens).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
        F.array_min(F.transform("licenses", lambda x: x["contained"])).alias("least_contained"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches")).select("doc_id", "item_id", "edits")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    finite = "not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    vectors = _table(spark, sf_dir, "embeddings").filter(finite)
    x = F.expr("transform(embedding, x -> cast(floor(256 * double(x)) as long))")
    vectors = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), x.alias("x"))
    return hardneg.hard_negatives(vectors, F.col("id") % 100 == 0)


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), slip_every=31)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_files": op2_token_files,
    "op3_language_id": op3_language_id,
    "op4_warc_chunks": op4_warc_chunks,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_license_scan": op9_license_scan,
    "op10_decontaminate": op10_decontaminate,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

TWINS = {
    "op1_quality_rules": quality.TWIN,
    "op6_line_dedup": linededup.TWIN,
    "op7_chat_format": chat.TWIN,
    "op11_hard_negatives": hardneg.TWIN,
    "op12_minhash_dedup": minhash.TWIN,
}
