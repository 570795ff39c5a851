"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Every tree takes its own hash-chosen sample, trees are grown in parallel as one small group
each, and scoring walks all trees at once over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.functions import features
from roadfuse.model.artifact import ForestNode
from roadfuse.operators.quantile import exact_quantile

_FEATURES = [f"x{i}" for i in range(len(features.OUTLIER_FEATURES))]
_NODE = "tree_id int, node_id int, feature int, threshold double, left int, right int, path_length double"


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def outlier_inputs(df: DataFrame) -> list[Column]:
    return features.outlier_features(
        F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"), F.col("speed_mps")
    )


def tree_samples(rows: DataFrame, n: int, trees: int, sample: int, seed: int, excess: float = 2.0) -> DataFrame:
    """``sample`` rows per tree: those with the smallest hash of (id, tree).

    Rows are thinned by hashes first, to about ``excess`` times the need per tree: one hash decides
    whether a row is looked at for any tree, and only rows that are get one hash per tree. The
    data is never multiplied by the number of trees before the exact cut.
    """
    rate = min(1.0, excess * sample / n)
    looked_at = min(1.0, rate * trees)

    def below(share: float) -> int:
        return min(int(share * 2.0**64) - 2**63, 2**63 - 1)

    def key(tree: Column) -> Column:
        return F.xxhash64(F.col("client_id"), tree, F.lit(seed))

    chosen = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: key(t) <= below(rate / looked_at)
    )
    picked = (
        rows.filter(F.xxhash64(F.lit(seed), F.col("client_id")) <= below(looked_at))
        .select(
            "client_id",
            *[c.cast("double").alias(n) for c, n in zip(outlier_inputs(rows), _FEATURES)],
            F.explode(chosen).alias("tree_id"),
        )
        .withColumn("h", key(F.col("tree_id")))
    )
    w = Window.partitionBy("tree_id").orderBy("h", "client_id")
    return picked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= sample).drop("h")


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, -1, False)]  # rows, depth, parent, is_right
    while todo:
        idx, depth, parent, is_right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            side = 4 if is_right else 3
            nodes[parent][side] = me
        low, high = x[idx].min(axis=0), x[idx].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or len(varied) == 0:
            nodes.append([me, -1, 0.0, me, me, depth + average_path(len(idx))])
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(low[f], high[f]))
        cut = cut if cut > low[f] else float(np.nextafter(low[f], high[f]))
        nodes.append([me, f, cut, -1, -1, 0.0])
        goes_left = x[idx, f] < cut
        todo.append((idx[~goes_left], depth + 1, me, True))
        todo.append((idx[goes_left], depth + 1, me, False))
    return nodes


def grow_forest(rows: DataFrame, n: int, trees: int, sample: int, seed: int) -> list[ForestNode]:
    """All nodes of the forest; at most ``trees * (2 * sample - 1)`` rows reach the driver."""
    size = min(sample, n)
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree_id"].iloc[0])
        grown = _grow(pdf[_FEATURES].to_numpy(float), np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(grown, columns=["node_id", "feature", "threshold", "left", "right", "path_length"])
        out.insert(0, "tree_id", tree)
        return out

    excess = 2.0
    while True:
        picked = tree_samples(rows, n, trees, sample, seed, excess).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            full = picked.groupBy("tree_id").count().filter(F.col("count") >= size).count()
            if full == trees or excess * sample >= n:
                nodes = picked.groupBy("tree_id").applyInPandas(build, _NODE)
                return [ForestNode(*r) for r in sorted(tuple(r) for r in nodes.collect())]
        finally:
            picked.unpersist()
        excess *= 2  # a tree fell short of its sample


def _flatten(nodes: tuple[ForestNode, ...]) -> dict[str, np.ndarray]:
    ordered = sorted(nodes, key=lambda n: (n.tree_id, n.node_id))
    start: dict[int, int] = {}
    for i, n in enumerate(ordered):
        start.setdefault(n.tree_id, i)
    base = np.array([start[n.tree_id] for n in ordered], dtype=np.int32)
    children = np.empty(2 * len(ordered), dtype=np.int32)
    children[0::2] = np.array([n.left for n in ordered]) + base
    children[1::2] = np.array([n.right for n in ordered]) + base
    return {
        "roots": np.array(sorted(start.values()), dtype=np.int32),
        "feature": np.array([max(n.feature, 0) for n in ordered], dtype=np.int32),
        "threshold": np.array([n.threshold if n.feature >= 0 else np.inf for n in ordered]),
        "children": children,
        "path": np.array([n.path_length for n in ordered]),
    }


def anomaly_score(df: DataFrame, nodes: tuple[ForestNode, ...], sample: int) -> Column:
    """Anomaly score in (0, 1) of every row; larger is more isolated."""
    flat = _flatten(nodes)
    shared = df.sparkSession.sparkContext.broadcast(flat)
    depth = math.ceil(math.log2(max(sample, 2)))

    @F.pandas_udf("double")
    def mean_path(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        t = shared.value
        x = np.column_stack([v.to_numpy(float) for v in (a, b, c, d, e)])
        out = np.empty(len(x))
        width = x.shape[1]
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            flat = np.ascontiguousarray(part).ravel()
            row = (np.arange(len(part), dtype=np.int32) * width)[:, None]
            at = np.broadcast_to(t["roots"], (len(part), len(t["roots"])))
            for _ in range(depth):
                v = flat.take(t["feature"].take(at) + row)
                at = t["children"].take(2 * at + (v >= t["threshold"].take(at)))
            out[lo : lo + 1024] = t["path"].take(at).mean(axis=1)
        return pd.Series(out)

    return F.pow(F.lit(2.0), -mean_path(*[c.cast("double") for c in outlier_inputs(df)]) / average_path(sample))


def outlier_threshold(rows: DataFrame, nodes, sample: int, contamination: float) -> float:
    """Cut of ``-score`` below which a training row counts as an outlier: an exact quantile at every size."""
    scored = rows.select((-anomaly_score(rows, nodes, sample)).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return exact_quantile(scored, "s", contamination)
    finally:
        scored.unpersist()
