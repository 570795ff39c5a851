"""Stream-stream pairing that also admits late observations, up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.functions import geo
from roadfuse.operators.pairing import whole_ms


def interval_pairs(
    frames: DataFrame, observations: DataFrame, window_ms: int, window_m: float, delay: str
) -> DataFrame:
    """Nearest observation per frame from two streams, in append mode.

    A frame's pair is emitted once no observation within its window can arrive any more.
    State is bounded by the watermark of both sides plus the window.
    """
    return _nearest(frames, observations, window_ms, window_m, delay, "inner", (), ())


def interval_outcomes(
    frames: DataFrame,
    observations: DataFrame,
    window_ms: int,
    window_m: float,
    delay: str,
    frame_columns: tuple[str, ...] = (),
    event_columns: tuple[str, ...] = (),
) -> DataFrame:
    """One row per frame of the stream, in append mode: its nearest observation, or nulls where none came in time.

    As :func:`interval_pairs`, but a frame without a candidate is emitted too, once the watermark has passed its
    window, so every frame that wasn't late itself has exactly one outcome. A frame behind the watermark is dropped by the
    stream. ``frame_columns`` and ``event_columns`` travel along in the state; names shared by both sides aren't allowed.
    """
    return _nearest(frames, observations, window_ms, window_m, delay, "left_outer", frame_columns, event_columns)


def _nearest(frames, observations, window_ms, window_m, delay, how, frame_columns, event_columns) -> DataFrame:
    width = 2 * window_ms * 1000

    def bucket(us):
        return F.floor(us / width)

    f_us, o_us = F.unix_micros("f_ts"), F.unix_micros("o_ts")
    probes = (
        frames.select(
            F.col("device_id").alias("f_device"),
            F.col("client_id").alias("frame_client_id"),
            F.col("ts_utc").alias("f_ts"),
            F.col("lat").alias("f_lat"),
            F.col("lon").alias("f_lon"),
            *frame_columns,
        )
        .withWatermark("f_ts", delay)
        .withColumn("f_bucket", F.explode(F.sequence(bucket(f_us - width // 2), bucket(f_us + width // 2))))
    )
    probes = geo.explode_cells(probes, "f_lat", "f_lon", window_m, "f_cell")
    spots = (
        observations.select(
            F.col("device_id").alias("o_device"),
            F.col("client_id").alias("event_client_id"),
            F.col("ts_utc").alias("o_ts"),
            F.col("lat").alias("o_lat"),
            F.col("lon").alias("o_lon"),
            *event_columns,
        )
        .withWatermark("o_ts", delay)
        .withColumn("o_bucket", bucket(o_us))
        .withColumn("o_cell", geo.grid_cell(F.col("o_lat"), F.col("o_lon"), window_m))
    )
    reach = F.expr(f"INTERVAL {window_ms / 1000:.3f} SECONDS")
    meets = (
        (F.col("f_device") == F.col("o_device"))
        & (F.col("f_bucket") == F.col("o_bucket"))
        & (F.col("f_cell") == F.col("o_cell"))
        & (F.col("o_ts") > F.col("f_ts") - reach)
        & (F.col("o_ts") < F.col("f_ts") + reach)
    )
    # The distance belongs to the condition: a frame whose candidates are all too far has none.
    d = geo.distance_m(F.col("f_lat"), F.col("f_lon"), F.col("o_lat"), F.col("o_lon"))
    near = probes.join(spots, meets & (d <= window_m), how).withColumns(
        {"delta_m": d, "delta_us": F.unix_micros("f_ts") - F.unix_micros("o_ts")}
    )
    order = F.struct(F.abs("delta_us"), "delta_m", "event_client_id")
    picked = F.struct("event_client_id", "delta_us", "delta_m", *event_columns)
    return (
        near.groupBy("frame_client_id", "f_ts", *frame_columns)
        .agg(F.min_by(picked, F.when(F.col("event_client_id").isNotNull(), order)).alias("p"))
        .select(
            "frame_client_id",
            "p.event_client_id",
            whole_ms(F.col("p.delta_us")).alias("delta_ms"),
            "p.delta_m",
            *frame_columns,
            *[f"p.{c}" for c in event_columns],
        )
    )
