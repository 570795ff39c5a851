"""Nearest same-device observation of every frame, in time first and space second."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions import geo
from roadfuse.functions.fusion import FusionStrategy, PairColumns
from roadfuse.session import cut_lineage


def whole_ms(delta_us: Column) -> Column:
    """Microseconds to whole milliseconds, halves away from zero, sign kept."""
    size = F.floor((F.abs(delta_us) + 500) / 1000)
    return F.when(delta_us < 0, -size).otherwise(size)


def candidate_pairs(
    frames: DataFrame, observations: DataFrame, window_ms: int, window_m: float
) -> DataFrame:
    """All (frame, observation spot) pairs of one device inside both windows.

    The join key is (device, time bucket, grid cell), so no device, minute or road section is
    compared as a whole. Buckets and cells are two windows wide and only the frame side is
    repeated, for the buckets and cells its window touches. Observations at one spot and
    instant are first reduced to their smallest id: no other of them can be nearest.
    """
    window_us = window_ms * 1000

    def bucket(us: Column) -> Column:
        return F.floor(us / (2 * window_us))

    at, f_at = F.unix_micros("ts_utc"), F.col("f_us")
    spots = (
        observations.groupBy("device_id", "ts_utc", "lat", "lon")
        .agg(F.min("client_id").alias("event_client_id"))
        .select(
            "device_id",
            "event_client_id",
            at.alias("o_us"),
            F.col("lat").alias("o_lat"),
            F.col("lon").alias("o_lon"),
            bucket(at).alias("bucket"),
            geo.grid_cell(F.col("lat"), F.col("lon"), window_m).alias("cell"),
        )
    )
    placed = geo.explode_cells(
        frames.select(
            "device_id",
            F.col("client_id").alias("frame_client_id"),
            at.alias("f_us"),
            F.col("lat").alias("f_lat"),
            F.col("lon").alias("f_lon"),
        ),
        "f_lat", "f_lon", window_m, "cell",
    )
    probes = placed.withColumn(
        "bucket", F.explode(F.sequence(bucket(f_at - window_us), bucket(f_at + window_us)))
    )
    near = (F.abs(F.col("f_us") - F.col("o_us")) < window_us) & (
        geo.distance_m(F.col("f_lat"), F.col("f_lon"), F.col("o_lat"), F.col("o_lon")) <= window_m
    )
    keys = ["device_id", "bucket", "cell"]
    return probes.join(spots, keys).filter(near).select(
        "frame_client_id",
        "event_client_id",
        (F.col("f_us") - F.col("o_us")).alias("delta_us"),
        geo.distance_m(F.col("f_lat"), F.col("f_lon"), F.col("o_lat"), F.col("o_lon")).alias("delta_m"),
    )


def _nearest(frames: DataFrame, observations: DataFrame, window_ms: int, window_m: float) -> DataFrame:
    first = Window.partitionBy("frame_client_id").orderBy(
        F.abs("delta_us"), "delta_m", "event_client_id"
    )
    return (
        candidate_pairs(frames, observations, window_ms, window_m)
        .withColumn("rank", F.row_number().over(first))
        .filter("rank = 1")
        .select(
            "frame_client_id", "event_client_id", whole_ms(F.col("delta_us")).alias("delta_ms"), "delta_m"
        )
    )


def nearest_observation(
    frames: DataFrame,
    observations: DataFrame,
    window_ms: int = 3000,
    window_m: float = 25.0,
    first_ms: tuple[int, ...] = (),
) -> DataFrame:
    """One row per frame that has a candidate: ids, ``delta_ms`` and ``delta_m``.

    ``first_ms`` lists smaller time windows to try before the full one. Time decides before
    distance, so a frame that finds a candidate in a small window needs no larger one; where
    observations are very dense this saves most comparisons (see :func:`dense_steps`).
    """
    found = None
    for ms in (*first_ms, window_ms):
        hit = _nearest(frames, observations, ms, window_m)
        if ms != window_ms:
            hit = cut_lineage(hit)
            done = hit.select(F.col("frame_client_id").alias("client_id"))
            frames = cut_lineage(frames.join(done, "client_id", "left_anti"))
        found = hit if found is None else found.unionByName(hit)
    return found


def dense_steps(
    observations: DataFrame, window_ms: int, window_m: float, spots_per_key: int = 10_000
) -> tuple[int, ...]:
    """Smaller windows to try first, if some device has very many observations in one place.

    Counts them per join key with partial sums; only the largest count reaches the driver.
    """
    bucket = F.floor(F.unix_micros("ts_utc") / (2000 * window_ms))
    cell = geo.grid_cell(F.col("lat"), F.col("lon"), window_m)
    counts = observations.groupBy("device_id", bucket.alias("bucket"), cell.alias("cell")).count()
    densest = counts.agg(F.max("count")).first()[0] or 0
    steps = []
    ms = window_ms
    while densest > spots_per_key and ms > 1:
        ms, densest = max(1, ms // 8), densest // 8
        steps.insert(0, ms)
    return tuple(steps)


def around_frames(frames: DataFrame, observations: DataFrame, window_ms: int) -> DataFrame:
    """Observations that lie in the time span of this batch of frames.

    The two bounds become literals, so they reach the observation scan as pushed filters and
    a small batch does not read the whole history.
    """
    low, high = frames.agg(F.min("ts_utc"), F.max("ts_utc")).first()
    if low is None:
        return observations.limit(0)
    reach = datetime.timedelta(milliseconds=window_ms)
    return observations.filter(F.col("ts_utc").between(low - reach, high + reach))


SENSOR_COLUMNS = ("magnitude", "accel_std", "gbar_in_max", "speed_mps")


def attach_signals(
    pairs: DataFrame, frames: DataFrame, observations: DataFrame, scores: DataFrame | None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Adds the visual, sensor and (when scored) model columns a fusion strategy reads, and ``keep`` columns of the observation."""
    visual = frames.select(
        F.col("client_id").alias("frame_client_id"), F.col("device_probability").alias("visual_confidence")
    )
    sensor = observations.select(F.col("client_id").alias("event_client_id"), *SENSOR_COLUMNS, *keep)
    return with_scores(pairs.join(sensor, "event_client_id").join(visual, "frame_client_id"), scores)


def with_scores(pairs: DataFrame, scores: DataFrame | None) -> DataFrame:
    """Adds the model's columns of the observation to pairs, null where it isn't scored."""
    if scores is None:
        return pairs.withColumns(
            {c: F.lit(None).cast("double") for c in ("sensor_p_pothole", "sensor_severity")}
        )
    scored = scores.select(
        F.col("client_id").alias("event_client_id"), "sensor_p_pothole", "sensor_severity"
    )
    return pairs.join(scored, "event_client_id", "left")


def fuse(pairs: DataFrame, strategy: FusionStrategy, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with signals -> the measures of ``fusion_pair``."""
    return pairs.withColumn("_out", strategy.fuse(PairColumns.named())).select(
        "event_client_id",
        "frame_client_id",
        F.col("_out.fused_confidence").alias("fused_confidence"),
        F.col("_out.severity").alias("severity"),
        "delta_ms",
        "delta_m",
        *keep,
    )


def pair_and_fuse(
    frames: DataFrame,
    observations: DataFrame,
    scores: DataFrame | None,
    strategy: FusionStrategy,
    cfg: Config,
    first_ms: tuple[int, ...] = (),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every frame's nearest observation and their fused measures; ``keep`` columns of the observation stay."""
    pairs = nearest_observation(
        frames, observations, cfg.fusion_window_ms, cfg.fusion_window_m, first_ms
    )
    return fuse(attach_signals(pairs, frames, observations, scores, keep), strategy, keep)
