"""Upload sources: JSON request envelopes, frame metadata and frame blobs.

Each reader has a text-column form (`*_from_text`), so the same parsing serves files, a
message queue and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadfuse import schema
from roadfuse.config import Config

_CORRUPT = "_corrupt"


def _parse(df: DataFrame, text: str, ddl: str) -> DataFrame:
    shape = T.StructType.fromDDL(ddl).add(_CORRUPT, T.StringType())
    parsed = F.from_json(F.col(text), shape, {"columnNameOfCorruptRecord": _CORRUPT})
    # inline() keeps the parse in one place; as plain struct fields every later use of a field
    # would be optimised into a parse of its own.
    return df.select(*[F.col(c) for c in df.columns if c != text], F.inline(F.array(parsed)))


def observation_envelopes_from_text(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per request; ``_corrupt`` holds text that does not fit the envelope."""
    return _parse(df, text, schema.OBSERVATION_ENVELOPE)


def frame_metadata_from_text(df: DataFrame, text: str = "value") -> DataFrame:
    """One row per frame request; ``_corrupt`` holds text that does not fit."""
    return _parse(df, text, schema.FRAME_METADATA)


def read_observation_envelopes(spark: SparkSession, path: str) -> DataFrame:
    return observation_envelopes_from_text(spark.read.text(path))


def read_frame_metadata(spark: SparkSession, path: str) -> DataFrame:
    return frame_metadata_from_text(spark.read.text(path))


def explode_envelopes(envelopes: DataFrame) -> DataFrame:
    """One row per item, with its position in the request; other columns are kept. A request with null events gives one row without both."""
    kept = [c for c in envelopes.columns if c not in ("device_id", "events")]
    return envelopes.select(
        *kept, F.trim("device_id").alias("device_id"), F.posexplode_outer("events").alias("pos", "_e")
    ).select(*kept, "device_id", "pos", "_e.*")


def read_frame_blobs(spark: SparkSession, path: str, max_bytes: int = Config.max_frame_size_bytes) -> DataFrame:
    """Path, size and leading bytes of every blob; the content itself goes no further.

    Sizes come from the listing. Only blobs of 1 to ``max_bytes`` bytes are opened, because the
    filter on length reaches the source; the others have a null head.
    """
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length").between(1, max_bytes)
    opened = files.filter(fits).select("path", "length", F.substring("content", 1, 3).alias("head"))
    return opened.unionByName(files.filter(~fits).select("path", "length", F.lit(None).cast("binary").alias("head")))


def blob_path(device_id: Column, client_id: Column, bucket: str | None = None) -> Column:
    """Stored path of a frame: ``{device}/{client}.jpg``, optionally below a bucket."""
    parts = [device_id, F.concat(client_id, F.lit(".jpg"))]
    return F.concat_ws("/", *([F.lit(bucket)] if bucket else []), *parts)
