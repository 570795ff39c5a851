import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadfuse.operators import dbscan as grid
from roadfuse.operators import clusters
from roadfuse.operators.clusters import aggregate_clusters, group_median
from roadfuse.operators.components import connected_components


def brute(df, eps, min_points):
    x, y, ids = df.x.to_numpy(), df.y.to_numpy(), df.client_id.to_numpy()
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    near = d2 <= eps * eps
    core = near.sum(1) >= min_points
    comp = np.full(len(df), -1)
    n = 0
    for i in np.flatnonzero(core):
        if comp[i] >= 0:
            continue
        comp[i], todo = n, [i]
        while todo:
            for k in np.flatnonzero(near[todo.pop()] & core & (comp < 0)):
                comp[k] = n
                todo.append(k)
        n += 1
    lead = {c: min(ids[(comp == c) & core]) for c in range(n)}
    final = comp.copy()
    for i in np.flatnonzero(~core):
        at = np.flatnonzero(near[i] & core)
        if len(at):
            final[i] = min((d2[i, j], lead[comp[j]], comp[j]) for j in at)[2]
    label = {c: min(ids[final == c]) for c in range(n)}
    return {i: label[c] for i, c in zip(ids, final) if c >= 0}


def check(spark, points, eps, min_points, parts=4):
    rng = np.random.default_rng(9)
    df = pd.DataFrame(np.asarray(points, float), columns=["x", "y"])
    df.insert(0, "client_id", [f"p{i:05d}" for i in rng.permutation(len(df))])
    got = grid.dbscan(spark.createDataFrame(df).repartition(parts), eps, min_points)
    assert {r.client_id: r.label for r in got.collect()} == brute(df, eps, min_points)


RNG = np.random.default_rng(1)
MIXED = np.vstack([RNG.normal(0, 8, (400, 2)), RNG.normal((45, 0), 8, (300, 2)), RNG.uniform(-200, 200, (400, 2))])
CASES = {
    "uniform with borders": (RNG.uniform(0, 600, (600, 2)), 25, 4),
    "dense beside sparse": (MIXED, 25, 5),
    "copies": (np.repeat(RNG.uniform(0, 300, (60, 2)), 7, axis=0), 25, 8),
    "lattice at exactly eps": ([(i * 25.0, j * 25.0) for i in range(9) for j in range(9)], 25, 4),
    "only noise": (RNG.uniform(0, 1e6, (40, 2)), 25, 2),
    "single points count": (RNG.uniform(0, 1e4, (30, 2)), 25, 1),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    check(spark, *CASES[name])


def test_boxes_are_split_when_point_work_is_large(spark, monkeypatch):
    monkeypatch.setattr(grid, "PAIR_WORK", 10)
    check(spark, MIXED, 25, 5, parts=1)
    check(spark, np.vstack([RNG.uniform(0, 17, (300, 2)), RNG.uniform(0, 17, (300, 2)) + [42.0, 0]]), 25, 5, parts=7)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 120)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {j: 100 for j in range(101, 120)} | {201: 200}
    assert got == want


@pytest.mark.parametrize("bins", [3, 4096])
def test_group_median(spark, monkeypatch, bins):
    monkeypatch.setattr(clusters, "_BINS", bins)
    rng = np.random.default_rng(2)
    df = pd.DataFrame({"g": rng.integers(0, 7, 900), "v": np.round(rng.uniform(0, 1, 900), 2)})
    far = pd.DataFrame({"g": 60, "v": np.append(rng.uniform(0, 1, 400), 1e15)})  # one value makes all others share a bin
    df = pd.concat([df, far, pd.DataFrame({"g": [50, 51, 51], "v": [0.5, 0.0, 1.0]})])
    got = {r.g: r.median for r in group_median(spark.createDataFrame(df), "g", "v").collect()}
    assert got == pytest.approx(df.groupby("g").v.median().to_dict())


def test_aggregate(spark):
    rows = [("c", "a", "d1", 1.0, 10.0, 0.2, 0.0), ("c", "b", "d1", 2.0, 20.0, 0.4, 0.5), ("c", "e", "d2", 3.0, 30.0, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "label string, client_id string, device_id string, lat double, lon double, severity double, confidence double")
    r = aggregate_clusters(df.withColumn("ts_utc", F.current_timestamp())).first()
    w = [0.001, 0.5, 1.0]
    assert r.lat == pytest.approx(sum(a * b for a, b in zip(w, (1, 2, 3))) / sum(w))
    assert (r.observation_count, r.distinct_devices, r.severity) == (3, 2, 0.4)
    assert r.confidence == pytest.approx(0.5)
