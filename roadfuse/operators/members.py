"""Which observations take part in clustering."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.config import CLASS_POTHOLE, Config
from roadfuse.functions import geo


def best_fused(pairs: DataFrame) -> DataFrame:
    """Highest fused confidence of every observation."""
    return pairs.groupBy(F.col("event_client_id").alias("client_id")).agg(
        F.max("fused_confidence").alias("max_fused")
    )


def suppress_repaired(rows: DataFrame, clusters: DataFrame, eps_m: float) -> DataFrame:
    """Drops rows that a repaired cluster within ``eps_m`` already explains.

    A row survives when it is newer than every such repair. Repairs of one spot count once,
    with their latest time, and meet the rows by grid cell.
    """
    repaired = (
        clusters.filter(F.col("repaired_at").isNotNull())
        .groupBy(F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
        .agg(F.max("repaired_at").alias("c_repaired_at"))
    )
    repaired = geo.explode_cells(repaired, "c_lat", "c_lon", eps_m, "c_cell")
    placed = rows.withColumn("_cell", geo.grid_cell(F.col("lat"), F.col("lon"), eps_m))
    explained = (
        (placed["_cell"] == repaired["c_cell"])
        & (repaired["c_repaired_at"] >= placed["ts_utc"])
        & (
            geo.distance_m(repaired["c_lat"], repaired["c_lon"], placed["lat"], placed["lon"])
            <= eps_m
        )
    )
    return placed.join(repaired, explained, "left_anti").drop("_cell")


def select_members(
    observations: DataFrame,
    scores: DataFrame,
    pairs: DataFrame,
    clusters: DataFrame,
    as_of: datetime.datetime,
    cfg: Config,
) -> DataFrame:
    """Recent potholes that are no outliers, or observations with a confident pair."""
    since = as_of - datetime.timedelta(days=cfg.cluster_window_days)
    scored = scores.select(
        "client_id", "sensor_class", "sensor_p_pothole", "sensor_severity", "sensor_is_outlier"
    )
    by_sensor = (F.col("sensor_class") == CLASS_POTHOLE) & ~F.coalesce("sensor_is_outlier", F.lit(False))
    by_pair = F.coalesce("max_fused", F.lit(0.0)) >= cfg.cluster_member_min_confidence
    rows = (
        observations.filter(F.col("received_at") > F.lit(since))
        .select("client_id", "device_id", "lat", "lon", "ts_utc")
        .join(scored, "client_id", "left")
        .join(best_fused(pairs), "client_id", "left")
        .filter(by_sensor | by_pair)
        .select(
            "client_id",
            "device_id",
            "lat",
            "lon",
            "ts_utc",
            F.coalesce("sensor_severity", F.lit(0.0)).alias("severity"),
            F.greatest(
                F.coalesce("sensor_p_pothole", F.lit(0.0)), F.coalesce("max_fused", F.lit(0.0))
            ).alias("confidence"),
        )
    )
    return suppress_repaired(rows, clusters, cfg.cluster_eps_m)


def member_stats(members: DataFrame) -> DataFrame:
    return members.agg(F.count("*").alias("n"), F.avg("lat").alias("mean_lat"))
