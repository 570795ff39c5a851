"""Row and envelope rules. Every rule that fails adds its name to ``reasons``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions.timeparse import parse_iso

Field = Callable[[str], Column]

# Inclusive bounds of the numeric fields; None means unbounded.
OBSERVATION_REQUIRED = {
    "lat": (-90.0, 90.0),
    "lon": (-180.0, 180.0),
    "speed_mps": (0.0, 200.0),
    "bearing_deg": (0.0, 360.0),
    "accel_max_g": (-50.0, 50.0),
    "accel_std": (0.0, 100.0),
    "magnitude": (0.0, 500.0),
    "confidence": (0.0, 1.0),
}
OBSERVATION_OPTIONAL = {
    "speed_accuracy_mps": (0.0, 200.0),
    "gbar_in_max": (0.0, 500.0),
    "time_in_max": (0.0, None),
    "time_in_min": (0.0, None),
}
FRAME_REQUIRED = {"lat": (-90.0, 90.0), "lon": (-180.0, 180.0), "device_p_on_device": (0.0, 1.0)}
SCHEMA_VERSION = (1, 100)
ID_MAX, MODEL_ID_MAX, RAW_WINDOW_MAX = 64, 128, 50_000
JPEG_MAGIC = bytes.fromhex("FFD8FF")


def _within(c: Column, bounds: tuple[float, float | None]) -> Column:
    low, high = bounds
    ok = (c >= low) & ~F.isnan(c)
    return ok if high is None else ok & (c <= high)


def _required(c: Column, bounds) -> Column:
    return c.isNotNull() & _within(c, bounds)


def _optional(c: Column, bounds) -> Column:
    return c.isNull() | _within(c, bounds)


def _max_length(c: Column, n: int) -> Column:
    return c.isNull() | (F.length(c) <= n)


def _id_ok(c: Column) -> Column:
    return c.isNotNull() & F.length(c).between(1, ID_MAX)


def failures(rules: dict[str, Column]) -> Column:
    """Names of the broken rules, in rule order."""
    names = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    # Not array_compact: that one is interpreted and takes the rules out of generated code.
    return F.array_except(F.array(*names), F.array(F.lit(None).cast("string")))


def observation_rules(field: Field, parsed_ts: Column | None = None) -> dict[str, Column]:
    """``parsed_ts`` is the already parsed ``ts``, where the caller has it."""
    instant = parse_iso(field("ts")) if parsed_ts is None else parsed_ts
    version = F.coalesce(field("schema_version"), F.lit(SCHEMA_VERSION[0]))
    return {
        "client_id": _id_ok(field("client_id")),
        "schema_version": version.between(*SCHEMA_VERSION),
        "ts": instant.isNotNull(),
        **{n: _required(field(n), b) for n, b in OBSERVATION_REQUIRED.items()},
        **{n: _optional(field(n), b) for n, b in OBSERVATION_OPTIONAL.items()},
        "raw_window_b64": _max_length(field("raw_window_b64"), RAW_WINDOW_MAX),
        "frame_client_id": _max_length(field("frame_client_id"), ID_MAX),
    }


def frame_rules(field: Field, parsed_ts: Column | None = None) -> dict[str, Column]:
    return {
        "client_id": _id_ok(field("client_id")),
        "event_client_id": _max_length(field("event_client_id"), ID_MAX),
        "ts": (parse_iso(field("ts")) if parsed_ts is None else parsed_ts).isNotNull(),
        **{n: _required(field(n), b) for n, b in FRAME_REQUIRED.items()},
        "model_id": _max_length(field("model_id"), MODEL_ID_MAX),
        "detections": field("detections").isNull()
        | F.forall(field("detections"), lambda d: F.schema_of_variant(d).startswith("OBJECT")),
    }


def envelope_rules() -> dict[str, Column]:
    """Rules of the request itself: device id and API version."""
    return {
        "device_id": F.trim("device_id") != "",
        "accept_version": F.lower(F.trim("accept_version")) == "v1",
    }


def batch_rules(cfg: Config) -> dict[str, Column]:
    return {"batch_size": F.size("events").between(1, cfg.max_batch_size)}


def blob_reason(content_length: Column, head: Column, cfg: Config) -> Column:
    """``empty``, ``too_large`` or ``bad_magic`` (first that applies), else NULL."""
    return (
        F.when(content_length.isNull() | (content_length == 0), F.lit("empty"))
        .when(content_length > cfg.max_frame_size_bytes, F.lit("too_large"))
        .when(F.coalesce(head != F.lit(JPEG_MAGIC), F.lit(True)), F.lit("bad_magic"))
    )


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("reasons", failures(rules))
