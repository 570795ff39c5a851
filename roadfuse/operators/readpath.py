"""Read-side views of the clusters: public ones, map windows, tiles, retention."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions import geo
from roadfuse.operators.running import hash_byte, running_total

# Fixed values.
AGGREGATE_ZOOM = 14
TILE_ZOOMS = (10, 14, 18)
FRAME_DAYS = 90
DEVICE_BYTES = 500 * 1024 * 1024
TIGHT_BOX_M = 5.0
_MERCATOR_LAT = 85.05112877980659


def public_clusters(clusters: DataFrame, cfg: Config) -> DataFrame:
    return clusters.filter(
        F.col("repaired_at").isNull() & (F.col("distinct_devices") >= cfg.cluster_min_distinct_devices)
    )


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1)), F.lit(0)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    phi = F.radians(F.greatest(F.least(lat, F.lit(_MERCATOR_LAT)), F.lit(-_MERCATOR_LAT)))
    y = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n
    return F.greatest(F.least(F.floor(y), F.lit(n - 1)), F.lit(0)).cast("long")


def map_window(
    clusters: DataFrame,
    south: float,
    west: float,
    north: float,
    east: float,
    zoom: int,
    since: datetime.datetime | None = None,
) -> DataFrame:
    """Unrepaired clusters in a box: single items when zoomed in, one item per tile otherwise."""
    rows = clusters.filter(F.col("repaired_at").isNull() & F.col("lat").between(south, north))
    if west <= east:
        rows = rows.filter(F.col("lon").between(west, east))
    else:
        rows = rows.filter((F.col("lon") >= west) | (F.col("lon") <= east))
    if since is not None:
        rows = rows.filter(F.col("last_seen") >= F.lit(since))
    if zoom > AGGREGATE_ZOOM:
        return rows.select(
            F.lit("pothole").alias("type"), "cluster_id", "lat", "lon", "severity", "confidence",
            F.col("observation_count").alias("event_count"), "last_seen", "source",
        )
    return (
        rows.groupBy(tile_x(F.col("lon"), zoom + 4).alias("x"), tile_y(F.col("lat"), zoom + 4).alias("y"))
        .agg(
            F.avg("lat").alias("centroid_lat"),
            F.avg("lon").alias("centroid_lon"),
            F.count("*").alias("count"),
            F.max("severity").alias("max_severity"),
        )
        .select(F.lit("cluster").alias("type"), "centroid_lat", "centroid_lon", "count", "max_severity")
    )


def tile_sums(clusters: DataFrame, zoom: int = TILE_ZOOMS[-1], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums per asset type and tile (x, y) over unrepaired clusters, which merge: those of parts of the clusters add up. ``by`` columns part them further."""
    placed = clusters.filter(F.col("repaired_at").isNull()).withColumns({"x": tile_x(F.col("lon"), zoom), "y": tile_y(F.col("lat"), zoom)})
    return placed.groupBy(*by, "asset_type", "x", "y").agg(
        F.count("*").alias("clusters"),
        F.sum("observation_count").alias("observations"),
        F.max("severity").alias("max_severity"),
        F.sum("lat").alias("lat_sum"),
        F.sum("lon").alias("lon_sum"),
    )


def merged_tiles(sums: DataFrame, zoom: int, to: int) -> DataFrame:
    """Tiles of ``zoom`` as those of the coarser (or same) zoom ``to``: four times four by four make one of two levels up, and so on."""
    up = lambda c: F.shiftright(F.col(c), zoom - to).alias(c)
    summed = [F.sum(c).alias(c) for c in ("clusters", "observations", "lat_sum", "lon_sum")]
    return sums.groupBy("asset_type", up("x"), up("y")).agg(*summed, F.max("max_severity").alias("max_severity"))


def tiles_of(sums: DataFrame, zooms: tuple[int, ...] = TILE_ZOOMS) -> DataFrame:
    """Aggregates per asset type and tile of every zoom, rolled up level by level from sums at the finest one."""
    at, out = max(zooms), None
    for zoom in sorted(zooms, reverse=True):
        sums, at = merged_tiles(sums, at, zoom), zoom
        rows = sums.select(
            "asset_type", F.lit(zoom).alias("z"), "x", "y", "clusters", "observations", "max_severity",
            (F.col("lat_sum") / F.col("clusters")).alias("lat"), (F.col("lon_sum") / F.col("clusters")).alias("lon"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def zoom_tiles(clusters: DataFrame, zooms: tuple[int, ...] = TILE_ZOOMS) -> DataFrame:
    """Aggregates per asset type and map tile for every zoom band."""
    return tiles_of(tile_sums(clusters, max(zooms)), zooms)


def frames_to_delete(frames: DataFrame, as_of: datetime.datetime, budget: int = DEVICE_BYTES) -> DataFrame:
    """Frames past their age, or beyond the newest ``budget`` bytes of their device.

    Frames of one device and instant are taken in ``md5(client_id)`` order.
    """
    us = F.unix_micros("received_at")
    rows = frames.select("client_id", "device_id", "received_at", "jpeg_bytes").withColumns(
        {
            "aged": F.col("received_at") < F.lit(as_of - datetime.timedelta(days=FRAME_DAYS)),
            "_md5": F.md5("client_id"),
            "day": -F.floor(us / 86_400_000_000),
            "minute": -F.floor(us / 60_000_000),
            "ms": -F.floor(us / 1000),
        }
    )
    rows = rows.withColumn("slice", -us * 256 + hash_byte("_md5"))
    newest_first = running_total(
        rows, "jpeg_bytes", ["device_id"], ["day", "minute", "ms", "slice"], ["_md5", "client_id"]
    )
    return newest_first.filter(F.col("aged") | (F.col("running") > budget)).select(
        "client_id", "device_id", "aged", (F.col("running") > budget).alias("over_budget")
    )


def tight_clusters(links: DataFrame, observations: DataFrame, side_m: float = TIGHT_BOX_M) -> DataFrame:
    """Clusters whose members all lie in a box of ``side_m`` by ``side_m``."""
    placed = links.filter("kind = 'observation'").join(
        observations.select(F.col("client_id").alias("member_id"), "lat", "lon"), "member_id"
    )
    box = placed.groupBy("cluster_id").agg(
        F.count("*").alias("members"),
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"),
    )
    mid = (F.col("s") + F.col("n")) / 2.0
    return box.select(
        "cluster_id",
        "members",
        geo.distance_m(F.col("s"), F.col("w"), F.col("n"), F.col("w")).alias("height_m"),
        geo.distance_m(mid, F.col("w"), mid, F.col("e")).alias("width_m"),
    ).filter((F.col("height_m") <= side_m) & (F.col("width_m") <= side_m))
