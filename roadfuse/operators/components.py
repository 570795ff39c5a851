"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("big", "small")).alias("h")).first()
    return r.n, r.h


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges -> (``node``, ``component``); the component is its smallest node.

    Nodes that are their own component are left out. Each round is two aggregations with
    partial sums before the shuffle; a hub only ever meets one row per edge. Rounds are cut at
    the reliable checkpoint folder, so a lost executor never replays the whole loop.
    """
    e = (
        edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small"))
        .filter("big <> small")
        .distinct()
    )
    e = cut_lineage(e)
    mark = None
    while True:
        # Large-star: every larger neighbour of a node moves to the node's lowest neighbour.
        lowest = e.groupBy(F.col("big").alias("small")).agg(F.min("small").alias("low"))
        e = e.join(lowest, "small", "left").select("big", F.coalesce("low", "small").alias("small")).distinct()
        # Small-star: a node and its smaller neighbours move to the lowest of them.
        lowest = e.groupBy("big").agg(F.min("small").alias("low"))
        moved = e.join(lowest, "big").filter("small <> low").select(F.col("small").alias("big"), F.col("low").alias("small"))
        e = moved.union(lowest.select("big", F.col("low").alias("small"))).distinct()
        e = cut_lineage(e)
        last, mark = mark, _signature(e)
        if mark == last:
            break
    return e.select(F.col("big").alias("node"), F.col("small").alias("component"))
