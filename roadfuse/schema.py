"""Declared schemas of the upload formats and the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

OBSERVATION_ITEM = (
    "client_id STRING, schema_version INT, ts STRING, lat DOUBLE, lon DOUBLE, "
    "speed_mps DOUBLE, bearing_deg DOUBLE, speed_accuracy_mps DOUBLE, accel_max_g DOUBLE, "
    "accel_std DOUBLE, magnitude DOUBLE, gbar_in_max DOUBLE, time_in_max DOUBLE, "
    "time_in_min DOUBLE, confidence DOUBLE, raw_window_b64 STRING, visual_confirmed BOOLEAN, "
    "frame_client_id STRING"
)

# One upload request; received_at and request_id are stamped by the receiver.
OBSERVATION_ENVELOPE = (
    "request_id STRING, device_id STRING, accept_version STRING, received_at TIMESTAMP, "
    f"events ARRAY<STRUCT<{OBSERVATION_ITEM}>>"
)

FRAME_METADATA = (
    "request_id STRING, device_id STRING, accept_version STRING, received_at TIMESTAMP, path STRING, "
    "client_id STRING, event_client_id STRING, ts STRING, lat DOUBLE, lon DOUBLE, "
    "device_p_on_device DOUBLE, model_id STRING, detections ARRAY<VARIANT>"
)

TABLES = {
    "asset_type": "asset_type STRING, display_name STRING, description STRING, icon_url STRING",
    "observation": (
        "client_id STRING, device_id STRING, asset_type STRING, schema_version INT, ts_utc TIMESTAMP, "
        "lat DOUBLE, lon DOUBLE, speed_mps DOUBLE, bearing_deg DOUBLE, speed_accuracy_mps DOUBLE, "
        "accel_max_g DOUBLE, accel_std DOUBLE, magnitude DOUBLE, gbar_in_max DOUBLE, time_in_max DOUBLE, "
        "time_in_min DOUBLE, confidence DOUBLE, raw_window_b64 STRING, visual_confirmed BOOLEAN, "
        "frame_client_id STRING, received_at TIMESTAMP"
    ),
    "observation_score": (
        "client_id STRING, sensor_class STRING, sensor_p_pothole DOUBLE, sensor_severity DOUBLE, "
        "sensor_is_outlier BOOLEAN, sensor_model_version STRING, scored_at TIMESTAMP"
    ),
    "frame": (
        "client_id STRING, device_id STRING, event_client_id STRING, ts_utc TIMESTAMP, lat DOUBLE, lon DOUBLE, "
        "device_probability DOUBLE, device_model_id STRING, device_detections STRING, jpeg_url STRING, "
        "jpeg_bytes LONG, received_at TIMESTAMP"
    ),
    "frame_processed": "client_id STRING, processed_at TIMESTAMP",
    "fusion_pair": (
        "event_client_id STRING, frame_client_id STRING, fused_confidence DOUBLE, severity DOUBLE, "
        "delta_ms LONG, delta_m DOUBLE, fusion_run_id STRING, created_at TIMESTAMP"
    ),
    "fused_max": "client_id STRING, max_fused DOUBLE",
    "closed_batch": "source STRING, closed STRING",
    "cluster": (
        "cluster_id STRING, asset_type STRING, lat DOUBLE, lon DOUBLE, severity DOUBLE, confidence DOUBLE, "
        "observation_count LONG, distinct_devices LONG, last_seen TIMESTAMP, source STRING, "
        "repaired_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "tile_part": (
        "asset_type STRING, x LONG, y LONG, clusters LONG, observations LONG, max_severity DOUBLE, lat_sum DOUBLE, lon_sum DOUBLE"
    ),
    "cluster_link": "cluster_id STRING, member_id STRING, kind STRING, fused_confidence DOUBLE",
    "fusion_run": (
        "run_id STRING, engine_version STRING, weights MAP<STRING, DOUBLE>, started_at TIMESTAMP, "
        "completed_at TIMESTAMP, inputs_count LONG, outputs_count LONG, "
        "metrics STRUCT<frames: LONG, pairs: LONG, sensor_model_version: STRING>"
    ),
    "cluster_run": (
        "run_id STRING, started_at TIMESTAMP, completed_at TIMESTAMP, inputs_count LONG, outputs_count LONG, "
        "params STRUCT<eps_m: DOUBLE, eps_units_3857: DOUBLE, min_points: INT, window_days: INT, "
        "member_min_confidence: DOUBLE, mean_lat: DOUBLE>"
    ),
    "sensor_model": (
        "model_version STRING, k INT, n_observations LONG, bic DOUBLE, "
        "standardization STRUCT<ratio: STRUCT<mean: DOUBLE, std: DOUBLE>, gbar: STRUCT<mean: DOUBLE, std: DOUBLE>>, "
        "components ARRAY<STRUCT<mu: ARRAY<DOUBLE>, sigma: ARRAY<ARRAY<DOUBLE>>, weight: DOUBLE, class: STRING>>, "
        "severity_calib STRUCT<speed_ref: DOUBLE, scale: DOUBLE>, forest_sample INT, outlier_threshold DOUBLE, "
        "fitted_at TIMESTAMP"
    ),
    "sensor_forest": (
        "model_version STRING, tree_id INT, node_id INT, feature INT, threshold DOUBLE, "
        "left INT, right INT, path_length DOUBLE"
    ),
    "model_activation": "model_version STRING, activated_at TIMESTAMP",
    "ingest_accepted": "resource STRING, request_id STRING, pos INT, client_id STRING",
    "ingest_rejected": "resource STRING, request_id STRING, pos INT, client_id STRING, reasons ARRAY<STRING>",
    "rate_limit_decision": (
        "device_id STRING, resource STRING, request_id STRING, received_at TIMESTAMP, n LONG, "
        "current LONG, limit LONG, allowed BOOLEAN"
    ),
    "device_rate_limit": (
        "device_id STRING, resource STRING, window_start TIMESTAMP, request_count LONG"
    ),
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], table_schema(name))


def asset_types(spark: SparkSession) -> DataFrame:
    """The seeded asset-type dimension (fixed value)."""
    return spark.createDataFrame(
        [("pothole", "Pothole", "Road surface damage detected by accelerometer or camera.", None)],
        table_schema("asset_type"),
    )
