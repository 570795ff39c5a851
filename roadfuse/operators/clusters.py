"""Aggregates of labelled cluster members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.functions import geo
from roadfuse.operators.dbscan import dbscan
from roadfuse.session import cut_lineage

WEIGHT_FLOOR = 0.001  # fixed value
_BINS = 4096


def label_members(members: DataFrame, mean_lat: float, eps_m: float, min_points: int) -> DataFrame:
    """Members of a cluster with their ``label``; noise is dropped."""
    planar = members.withColumns(
        {"x": geo.mercator_x(F.col("lon")), "y": geo.mercator_y(F.col("lat"))}
    )
    return dbscan(planar, geo.mercator_eps(eps_m, mean_lat), min_points).drop("x", "y")


def group_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Exact interpolated median per group, as ``median``; null values don't count.

    Equal values are counted first. Then both middle ranks are narrowed down in passes: each
    counts ``_BINS`` bins between the bounds found so far and keeps the one bin that holds the
    rank, until a single value is left. No group's values meet in one task, however they are spread.
    """
    counts = cut_lineage(rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n")))
    extent = counts.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.sum("n").alias("total"))
    ranks = F.array(F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2))
    state = cut_lineage(extent.select(group, "low", "high", F.lit(0).cast("long").alias("before"), F.posexplode(ranks).alias("side", "rank")))
    while True:
        opened = state.filter("low < high")
        if opened.isEmpty():
            break
        inside = counts.join(opened, group).filter(F.col(value).between(F.col("low"), F.col("high")))
        # The top bin is the highest value alone, so that every pass parts two values at least.
        place = F.when(F.col(value) == F.col("high"), F.lit(_BINS)).otherwise(
            F.least(F.floor((F.col(value) - F.col("low")) / ((F.col("high") - F.col("low")) / _BINS)), F.lit(_BINS - 1))
        )
        hist = inside.groupBy(group, "side", "rank", "before", place.alias("bin")).agg(
            F.sum("n").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        )
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(group, "side").orderBy("bin"))
        found = hist.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        narrowed = found.select(group, "low", "high", (F.col("upto") - F.col("n")).alias("before"), "side", "rank")
        state = cut_lineage(state.filter("low = high").unionByName(narrowed))
    return state.groupBy(group).agg((F.sum("low") / 2).alias("median"))


def aggregate_clusters(labelled: DataFrame) -> DataFrame:
    """One row per cluster: weighted centroid, median severity, mean confidence, counts.

    Sums run per (cluster, device) first, so a cluster holding most members is spread over
    its devices and the distinct count needs no expansion.
    """
    w = F.greatest("confidence", F.lit(WEIGHT_FLOOR))
    per_device = labelled.groupBy("label", "device_id").agg(
        F.sum(w).alias("w"),
        F.sum(F.col("lat") * w).alias("lat_w"),
        F.sum(F.col("lon") * w).alias("lon_w"),
        F.sum("confidence").alias("confidence"),
        F.count("*").alias("n"),
        F.max("ts_utc").alias("last_seen"),
    )
    totals = per_device.groupBy("label").agg(
        (F.sum("lat_w") / F.sum("w")).alias("lat"),
        (F.sum("lon_w") / F.sum("w")).alias("lon"),
        (F.sum("confidence") / F.sum("n")).alias("confidence"),
        F.sum("n").alias("observation_count"),
        F.count("*").alias("distinct_devices"),
        F.max("last_seen").alias("last_seen"),
    )
    severity = group_median(labelled, "label", "severity").withColumnRenamed("median", "severity")
    return totals.join(severity, "label")


def member_rows(labelled: DataFrame) -> DataFrame:
    """Member ids and confidences per cluster, as rows instead of one array per cluster."""
    return labelled.select(
        "label", F.col("client_id").alias("member_id"), F.col("confidence").alias("fused_confidence")
    )
