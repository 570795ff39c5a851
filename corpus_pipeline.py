"""A training corpus from ``documents``: one operator after the other, each result stored as Parquet.

Every stage keeps the columns of ``documents`` but the last, which returns the tokens. Null texts and
texts without a letter go in the first stage; a null doc_id is kept and never linked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadfuse.llm import bpe, decontaminate, jaccard, langid, linededup
from roadfuse.llm.shared import small_batches, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose language is rejected; the model learns from the labelled ones that aren't held out."""
    small_batches(spark)
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).filter("not rejected").select(docs.columns)


def delete_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated runs of lines, whole to both sides, and without documents of which no word is left; n_chars counts what is left."""
    cleaned = linededup.delete_repeated_lines(docs)
    empty = (F.col("n_deleted") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = {"n_chars": F.when(F.col("n_deleted") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cleaned.filter(~empty).withColumns(changed).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents only the one of the smallest doc_id; repeated rows of it stay."""
    linked = jaccard.link_components(docs.select("doc_id", "text"))
    dropped = written(linked.filter("doc_id <> component_id").select("doc_id").distinct(), "pipeline-duplicates")
    # Joined the same way at every size; a broadcast would only last as long as few copies are found.
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of ``benchmark``."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their digests; the ids decode to the text's bytes."""
    import public_tokenizers

    # The idle workers of earlier stages and Spark's full heap leave little of an executor.
    small_batches(spark, 2 << 20)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return bpe.digests(tokens).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("line_dedup", delete_repeats),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("encode", encode_tokens),
]

#: Language identification and tokenization are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
