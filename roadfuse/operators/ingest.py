"""Validation, quarantine and idempotent append of uploads."""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions.timeparse import parse_iso
from roadfuse.operators import validate
from roadfuse.operators.idfilter import StoredIds
from roadfuse.schema import table_schema
from roadfuse.sources.uploads import blob_path, explode_envelopes


class IngestResult(NamedTuple):
    accepted: DataFrame  # request_id, pos, client_id; duplicates and repeats included
    rejected: DataFrame  # request_id, pos, client_id, reasons
    new_rows: DataFrame  # rows to append to the target
    checked: DataFrame  # the cached items behind all three; unpersist when done


def first_by_id(rows: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first arrival of every key.

    Spark turns ``rank = 1`` into a per-task limit before the shuffle, so a key that holds
    most of the rows still sends one row per task.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def absent_from(rows: DataFrame, existing: DataFrame | StoredIds, key: str) -> DataFrame:
    """Rows whose key the target does not hold yet.

    Stored ids answer by their filters first. A plain target is first reduced to the keys of this batch: a batch small
    enough to broadcast then only costs a scan of the target's key column instead of a shuffle of the target.
    """
    if isinstance(existing, StoredIds):
        return existing.absent(rows, key)
    known = existing.select(key).join(rows.select(key), key, "left_semi")
    return rows.join(known, key, "left_anti")


def append_new(rows: DataFrame, existing: DataFrame | StoredIds, key: str, order: list[str | Column]) -> DataFrame:
    """Insert-if-absent: the first arrival of every key the target lacks."""
    return absent_from(first_by_id(rows, key, order), existing, key)


def _as_table(df: DataFrame, name: str) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(name).fields]
    )


def _reject_envelopes(envelopes: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``_reasons`` of the request as a whole (malformed text first)."""
    malformed = F.array(F.lit("malformed"))
    reasons = F.when(F.col("_corrupt").isNotNull(), malformed).otherwise(validate.failures(rules))
    return envelopes.withColumn("_reasons", reasons)


def ingest_observations(
    envelopes: DataFrame, existing: DataFrame | StoredIds, cfg: Config, mode: str = "per_row"
) -> IngestResult:
    """Envelopes -> accepted ids, rejected items and new observation rows.

    ``per_row`` quarantines single bad items; ``whole_batch`` refuses every item of a request
    that has a bad one.
    """
    if mode not in ("per_row", "whole_batch"):
        raise ValueError(f"unknown mode {mode!r}")
    rules = validate.envelope_rules() | validate.batch_rules(cfg)
    checked = _reject_envelopes(envelopes, rules)
    whole = F.array().cast("array<string>")
    if mode == "whole_batch":
        fails = F.exists(
            "events", lambda e: F.size(validate.failures(validate.observation_rules(e.getField))) > 0
        )
        checked = checked.withColumn("batch_fails", F.when(F.size("_reasons") == 0, fails))
        whole = F.when(F.col("batch_fails"), F.array(F.lit("batch"))).otherwise(whole)
    # A request that is refused as a whole stays as one row without position and item, so texts are parsed once for all outputs.
    items = explode_envelopes(checked.withColumn("events", F.when(F.size("_reasons") == 0, F.col("events"))))
    items = items.withColumn("ts_utc", parse_iso(F.col("ts")))
    items = items.withColumn("_own", validate.failures(validate.observation_rules(F.col, F.col("ts_utc"))))
    own = F.when(F.size("_own") > 0, F.col("_own")).otherwise(whole)
    items = items.withColumn("reasons", F.when(F.size("_reasons") > 0, F.col("_reasons")).otherwise(own))
    items = items.drop("ts", "_corrupt", "_reasons", "_own", "accept_version", "batch_fails")
    # Parsed and checked once for all outputs, and for both sides of the insert-if-absent.
    items = items.persist(StorageLevel.MEMORY_AND_DISK)
    ok = items.filter(F.size("reasons") == 0)
    rejected = items.filter(F.size("reasons") > 0).select("request_id", "pos", "client_id", "reasons")
    rows = ok.withColumns(
        {
            "schema_version": F.coalesce("schema_version", F.lit(1)),
            "asset_type": F.lit("pothole"),
        }
    )
    new = append_new(rows, existing, "client_id", ["received_at", "request_id", "pos"])
    return IngestResult(ok.select("request_id", "pos", "client_id"), rejected, _as_table(new, "observation"), items)


def ingest_frames(metadata: DataFrame, blobs: DataFrame, existing: DataFrame | StoredIds, cfg: Config) -> IngestResult:
    """Frame requests and their blobs -> accepted ids, rejected requests and new frame rows."""
    metadata = metadata.withColumn("ts_utc", parse_iso(F.col("ts")))
    rules = validate.envelope_rules() | validate.frame_rules(F.col, F.col("ts_utc"))
    checked = _reject_envelopes(metadata, rules).join(blobs, "path", "left")
    reason = validate.blob_reason(F.col("length"), F.col("head"), cfg)
    reasons = F.when(F.size("_reasons") > 0, F.col("_reasons")).otherwise(F.array_compact(F.array(reason)))
    checked = checked.withColumns({"reasons": reasons, "pos": F.lit(0)})
    checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
    ok = checked.filter(F.size("reasons") == 0)
    rejected = checked.filter(F.size("reasons") > 0).select("request_id", "pos", "client_id", "reasons")
    device = F.trim("device_id")
    rows = ok.withColumns(
        {
            "jpeg_url": blob_path(device, F.col("client_id"), cfg.storage_bucket),
            "device_id": device,
            "device_probability": F.col("device_p_on_device"),
            "device_model_id": F.col("model_id"),
            "device_detections": F.when(F.size("detections") > 0, F.to_json("detections")),
            "jpeg_bytes": F.col("length"),
        }
    )
    new = append_new(rows, existing, "client_id", ["received_at", "request_id"])
    return IngestResult(ok.select("request_id", "pos", "client_id"), rejected, _as_table(new, "frame"), checked)
