"""Keyed upsert and rebuild of snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``source`` rows replace target rows of the same key; ``keep`` columns stay as stored.

    The target is only filtered by the keys of the source, never outer-joined: a source small
    enough to broadcast merges without shuffling the target.
    """
    touched = source.select(*keys)
    unchanged = target.join(touched, keys, "left_anti")
    stored = target.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep]).join(touched, keys, "left_semi")
    merged = source.join(stored.withColumn("_hit", F.lit(True)), keys, "left").select(
        *[
            (F.when(F.col("_hit"), F.col(f"_old_{c}")).otherwise(F.col(c)) if c in keep else F.col(c)).alias(c)
            for c in target.columns
        ]
    )
    return unchanged.unionByName(merged)


def rebuild_links(links: DataFrame, new_links: DataFrame) -> DataFrame:
    """Links of the touched clusters are replaced, all others stay."""
    touched = new_links.select("cluster_id").distinct()
    return links.join(touched, "cluster_id", "left_anti").unionByName(new_links)


def delete_cascade(parents_gone: DataFrame, key: str, children: DataFrame, child_key: str) -> DataFrame:
    """Children whose parent is not among the deleted ones."""
    return children.join(parents_gone.select(F.col(key).alias(child_key)), child_key, "left_anti")


def set_null_missing(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """``column`` becomes NULL where its parent no longer exists."""
    known = parents.select(F.col(key).alias("_key"), F.lit(True).alias("_known"))
    joined = children.join(known, children[column] == known["_key"], "left")
    return joined.withColumn(column, F.when(F.col("_known"), F.col(column))).select(*children.columns)
