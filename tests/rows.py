"""Rows of the stored tables, as the tests build them."""

import datetime

UTC = datetime.timezone.utc
BASE = datetime.datetime(2026, 5, 27, 10, 30, tzinfo=UTC)
LAT, LON = 43.6532, -79.3832


def at(seconds: float = 0.0) -> datetime.datetime:
    return BASE + datetime.timedelta(seconds=seconds)


def observation(client_id: str, **kw) -> dict:
    row = dict(
        client_id=client_id, device_id="dev-1", asset_type="pothole", schema_version=1, ts_utc=BASE,
        lat=LAT, lon=LON, speed_mps=12.0, bearing_deg=0.0, speed_accuracy_mps=None, accel_max_g=1.0,
        accel_std=1.0, magnitude=3.0, gbar_in_max=2.0, time_in_max=None, time_in_min=None, confidence=1.0,
        raw_window_b64=None, visual_confirmed=None, frame_client_id=None, received_at=BASE,
    )
    return row | kw


def frame(client_id: str, **kw) -> dict:
    row = dict(
        client_id=client_id, device_id="dev-1", event_client_id=None, ts_utc=BASE, lat=LAT, lon=LON,
        device_probability=0.8, device_model_id=None, device_detections=None, jpeg_url=f"dev-1/{client_id}.jpg",
        jpeg_bytes=1000, received_at=BASE,
    )
    return row | kw


def score(client_id: str, **kw) -> dict:
    row = dict(
        client_id=client_id, sensor_class="pothole", sensor_p_pothole=0.9, sensor_severity=0.5,
        sensor_is_outlier=False, sensor_model_version="m", scored_at=BASE,
    )
    return row | kw


def table(spark, name: str, rows: list[dict]):
    from roadfuse.schema import table_schema

    schema = table_schema(name)
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in rows], schema)
