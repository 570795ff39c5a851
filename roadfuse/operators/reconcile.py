"""Matching fresh clusters to stored ones without a driver loop over clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.functions import geo
from roadfuse.session import cut_lineage


def candidate_matches(fresh: DataFrame, clusters: DataFrame, eps_m: float) -> DataFrame:
    """(label, cluster_id, distance) of unrepaired stored clusters within ``eps_m``."""
    stored = clusters.filter(F.col("repaired_at").isNull()).select(
        "cluster_id",
        F.col("lat").alias("c_lat"),
        F.col("lon").alias("c_lon"),
        geo.grid_cell(F.col("lat"), F.col("lon"), eps_m).alias("cell"),
    )
    probes = geo.explode_cells(fresh.select("label", "lat", "lon"), "lat", "lon", eps_m, "cell")
    d = geo.distance_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    return (
        probes.join(stored, "cell")
        .withColumn("distance", d)
        .filter(F.col("distance") <= eps_m)
        .select("label", "cluster_id", "distance")
    )


def _standing(edges: DataFrame) -> DataFrame:
    """Edges that can still matter, each with ``pref`` (place in its label's order), ``turn`` (place of the label at the cluster) and ``ahead`` (the label before it there).

    A label never goes beyond the first cluster at which no smaller label is left, so later edges of it are dropped.
    """
    turn = Window.partitionBy("cluster_id").orderBy("label")
    best = Window.partitionBy("label").orderBy("distance", "cluster_id")
    edges = edges.withColumns({"turn": F.row_number().over(turn), "ahead": F.lag("label").over(turn)}).withColumn("pref", F.row_number().over(best))
    sure = F.min(F.when(F.col("turn") == 1, F.col("pref"))).over(Window.partitionBy("label"))
    return edges.withColumn("sure", sure).filter(F.col("sure").isNull() | (F.col("pref") <= F.col("sure"))).drop("sure")


def _outcomes(standing: DataFrame, waiting: DataFrame) -> DataFrame:
    """(label, on, given, choice): what each label of ``waiting`` (label, on) takes, for everything that the one label it waits for may take.

    ``given`` and ``choice`` are null for no cluster at all.
    """
    order = F.transform(F.array_sort(F.collect_list(F.struct("pref", "cluster_id"))), lambda e: e["cluster_id"])
    lists = standing.groupBy("label").agg(order.alias("wanted"))
    given = lists.select(F.col("label").alias("on"), F.explode(F.concat("wanted", F.array(F.lit(None).cast("string")))).alias("given"))
    free = F.get(F.filter("wanted", lambda c: ~c.eqNullSafe(F.col("given"))), F.lit(0))
    return waiting.join(lists, "label").join(given, "on").select("label", "on", "given", free.alias("choice"))


def _doubled(table: DataFrame) -> DataFrame:
    """``table`` (label, on, given, choice) with every label that waits for another waiting one set on what that one waits for."""
    next_ = table.select(F.col("label").alias("on"), F.col("on").alias("_on"), F.col("given").alias("_given"), F.col("choice").alias("given"))
    met = (table["on"] == next_["on"]) & table["given"].eqNullSafe(next_["given"])
    waits = next_.select("on").distinct()
    moved = table.join(next_, met).select(table["label"], F.col("_on").alias("on"), F.col("_given").alias("given"), table["choice"])
    return cut_lineage(table.join(waits, "on", "left_anti").select("label", "on", "given", "choice").unionByName(moved))


def exclusive_matches(edges: DataFrame) -> DataFrame:
    """Greedy one-to-one matching in label order: each label takes its nearest free cluster.

    A label whose nearest cluster holds no smaller label takes it. A label that meets one smaller label only waits for
    that one: what it takes is a small table over what the other may take. Such tables are
    joined along the relation "waits for" by pointer doubling, so a chain of n labels is settled in log n steps of
    one round. Labels that meet several smaller ones wait for the next round; the smallest label left never does.
    """
    left = cut_lineage(edges.groupBy("label", "cluster_id").agg(F.min("distance").alias("distance")))
    settled = None
    while not left.isEmpty():
        standing = cut_lineage(_standing(left))
        taken = standing.filter("pref = 1 and turn = 1").select("label", F.col("cluster_id").alias("choice"))
        waits = F.collect_set("ahead")
        waiting = (
            standing.join(taken, "label", "left_anti")
            .groupBy("label")
            .agg(F.max("turn").alias("turn"), waits.alias("ahead"))
            .filter("turn = 2 and size(ahead) = 1")
            .select("label", F.col("ahead")[0].alias("on"))
        )
        waiting = cut_lineage(waiting)
        done = taken
        if not waiting.isEmpty():
            table = cut_lineage(_outcomes(standing, waiting))
            labels = waiting.select(F.col("label").alias("on"))
            while not table.join(labels, "on", "left_semi").isEmpty():
                table = _doubled(table)
            known = taken.select(F.col("label").alias("on"), F.col("choice").alias("given"))
            done = taken.unionByName(table.join(known, ["on", "given"]).select("label", "choice"))
        done = cut_lineage(done)
        final = done.filter("choice is not null").select("label", F.col("choice").alias("cluster_id"))
        settled = final if settled is None else settled.union(final)
        left = cut_lineage(left.join(done.select("label"), "label", "left_anti").join(final.select("cluster_id"), "cluster_id", "left_anti"))
    return settled if settled is not None else left.select("label", "cluster_id")


def reconcile(fresh: DataFrame, clusters: DataFrame, eps_m: float, run_id: str) -> DataFrame:
    """(label, cluster_id, is_new): the stored id where matched, else a stable new one."""
    matched = exclusive_matches(candidate_matches(fresh, clusters, eps_m))
    new_id = F.concat(F.lit("clu_"), F.md5(F.concat_ws("|", F.lit(run_id), "label")))
    return fresh.select("label").join(matched, "label", "left").select(
        "label",
        F.coalesce("cluster_id", new_id).alias("cluster_id"),
        F.col("cluster_id").isNull().alias("is_new"),
    )
