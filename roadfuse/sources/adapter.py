"""Observation and frame views over the supplied ``events`` table.

The table holds no positions, so a fixed projection derives them. The projection text is
shared by Spark and the SQL twins; only three spellings differ between the two dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {"div": "div", "epoch_us": "unix_micros(cast(ts as timestamp))"}
_SQL = {"div": "//", "epoch_us": "epoch_us(ts)"}

# Column -> expression. Integer numerators over double denominators are exact in both engines.
_COMMON = {
    "client_id": "'e' || lpad(cast(event_id as {text}), 9, '0')",
    "device_id": "'dev-' || cast(user_id % 20 as {text})",
    "ts_us": "1767225600000000 + ({epoch_us} - 1704067200000000) {div} 1000",
    "received_us": "{epoch_us}",
    "lat": (
        "(4360000 + (user_id % 61) * 1000 + ((event_id * 31) % 11 - 5) * 2"
        " + (case when event_id % 97 = 0 then (event_id % 1009) * 100 else 0 end)) / cast(100000 as double)"
    ),
    "lon": "(-7940000 + (user_id % 61) * 1000 + ((event_id * 17) % 13 - 6) * 2) / cast(100000 as double)",
}
_OBSERVATION = {
    "schema_version": "cast(1 as int)",
    "speed_mps": "cast(event_id % 30 as double)",
    "bearing_deg": "cast((event_id * 7) % 360 as double)",
    "speed_accuracy_mps": "cast(event_id % 5 as double)",
    "accel_max_g": "value / cast(50 as double)",
    "accel_std": "(5 + event_id % 10) / cast(10 as double)",
    "magnitude": "value / cast(10 as double)",
    "gbar_in_max": "case when event_id % 7 = 0 then null else value / cast(20 as double) end",
    "confidence": "(event_id % 101) / cast(100 as double)",
}
_FRAME = {
    "device_probability": "(event_id % 101) / cast(100 as double)",
    "jpeg_bytes": "(1 + event_id % 9) * 1000000",
}


def _items(columns: dict[str, str], dialect: dict[str, str], text: str) -> list[tuple[str, str]]:
    return [(name, e.format(text=text, **dialect)) for name, e in columns.items()]


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {name}" for name, e in _items(columns, _SPARK, "string")]


def sql_ctes() -> str:
    """``observation`` and ``frame`` as SQL common table expressions for the twins."""
    obs = ", ".join(f"{e} AS {n}" for n, e in _items(_COMMON | _OBSERVATION, _SQL, "varchar"))
    frm = ", ".join(f"{e} AS {n}" for n, e in _items(_COMMON | _FRAME, _SQL, "varchar"))
    return (
        f"observation AS (SELECT event_id, {obs} FROM events WHERE event_type <> 'purchase'), "
        f"frame AS (SELECT event_id, {frm} FROM events WHERE event_type = 'purchase')"
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``observation`` shape (plus ``event_id``, ``ts_us`` and ``received_us``)."""
    return (
        events(spark, sf_dir)
        .filter("event_type <> 'purchase'")
        .selectExpr("event_id", *_select(_COMMON | _OBSERVATION))
        .withColumns(
            {
                "asset_type": F.lit("pothole"),
                "ts_utc": F.timestamp_micros("ts_us"),
                "received_at": F.timestamp_micros("received_us"),
                "time_in_max": F.lit(None).cast("double"),
                "time_in_min": F.lit(None).cast("double"),
                "raw_window_b64": F.lit(None).cast("string"),
                "visual_confirmed": F.lit(None).cast("boolean"),
                "frame_client_id": F.lit(None).cast("string"),
            }
        )
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ``frame`` shape (plus ``event_id``, ``ts_us`` and ``received_us``)."""
    return (
        events(spark, sf_dir)
        .filter("event_type = 'purchase'")
        .selectExpr("event_id", *_select(_COMMON | _FRAME))
        .withColumns(
            {
                "event_client_id": F.lit(None).cast("string"),
                "ts_utc": F.timestamp_micros("ts_us"),
                "received_at": F.timestamp_micros("received_us"),
                "device_model_id": F.lit(None).cast("string"),
                "device_detections": F.lit(None).cast("string"),
                "jpeg_url": F.concat_ws("/", "device_id", F.concat("client_id", F.lit(".jpg"))),
            }
        )
    )
