import math

import pytest
from rows import LAT, LON
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions import features, fusion, geo
from roadfuse.functions.timeparse import parse_iso


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def num(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("m, s, want", [(3.0, 1.0, 3.0), (6.0, 2.0, 3.0), (3.0, 0.0, 0.0), (None, 1.0, 0.0), (3.0, None, 0.0)])
def test_ratio(spark, m, s, want):
    assert one(spark, features.ratio(num(m), num(s))) == want


def test_feature_vectors(spark):
    f = features.outlier_features(num(3.0), num(1.0), num(2.0), num(12.0))
    assert one(spark, F.array(*f)) == [3.0, 2.0, 3.0, 1.0, 12.0]
    assert one(spark, F.array(*features.classifier_features(num(3.0), num(1.0), num(None)))) == [3.0, 0.0]
    assert one(spark, F.array(*features.outlier_features(*[num(None)] * 4))) == [0.0] * 5


@pytest.mark.parametrize(
    "m, speed, want", [(10.0, 10.0, 1.0), (2.0, 20.0, 0.2), (2.0, 2.0, 0.8), (0.0, 5.0, 0.0), (None, 5.0, 0.0), (2.0, None, 0.8)]
)
def test_severity(spark, m, speed, want):
    assert one(spark, features.severity(num(m), num(speed), 5.0, 2.0)) == pytest.approx(want)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def logit(p):
    return math.log(p / (1 - p))


def fused(spark, strategy, **kw):
    base = dict(magnitude=3.0, accel_std=1.0, gbar_in_max=2.0, speed_mps=12.0, sensor_p_pothole=None,
                sensor_severity=None, visual_confidence=None, delta_ms=100.0, delta_m=3.0) | kw
    return one(spark, strategy.fuse(fusion.PairColumns(**{k: num(v) for k, v in base.items()})))


def test_sigmoid_and_logit(spark):
    assert one(spark, fusion.sigmoid(num(0.0))) == 0.5
    for p in (0.1, 0.3, 0.75, 0.9):
        assert one(spark, fusion.sigmoid(fusion.logit(num(p)))) == pytest.approx(p, abs=1e-9)
    assert one(spark, fusion.sigmoid(num(-800.0))) == 0.0


def test_primary_fusion(spark):
    s = fusion.primary(Config())
    assert fused(spark, s, sensor_p_pothole=0.5, visual_confidence=0.5).fused_confidence == pytest.approx(0.5)
    assert fused(spark, s, sensor_p_pothole=0.5).fused_confidence == pytest.approx(0.5)
    assert fused(spark, s).fused_confidence == 0.5
    got = fused(spark, s, sensor_p_pothole=0.88, visual_confidence=0.7).fused_confidence
    assert got == pytest.approx(sigmoid(0.5 * logit(0.88) + 0.5 * logit(0.7)), abs=1e-9)
    assert 0.0 < fused(spark, s, sensor_p_pothole=1.0, visual_confidence=1.0).fused_confidence < 1.0
    assert fused(spark, s, sensor_p_pothole=0.6, sensor_severity=0.42).severity == 0.42


def test_cold_start_fusion(spark):
    s = fusion.cold_start(Config())
    assert fused(spark, s, magnitude=6.0).fused_confidence > fused(spark, s, magnitude=2.0).fused_confidence
    assert fused(spark, s, magnitude=10.0, speed_mps=10.0).severity == 1.0


def test_strategy_choice():
    cfg = Config()
    assert fusion.select_strategy(cfg, True).version == "fusion.matlab_port_v1"
    assert fusion.select_strategy(cfg, False).version == "fusion.python_v1"
    assert fusion.select_strategy(Config(fusion_engine_version="fusion.python_v1"), True).version == "fusion.python_v1"
    fusion.register_strategy("mine", lambda c: fusion.FusionStrategy("mine", {}, lambda p: p.delta_m))
    assert fusion.select_strategy(Config(fusion_engine_version="mine"), True).version == "mine"


@pytest.mark.parametrize(
    "text, micros",
    [
        ("2026-05-27T10:30:00Z", 0),
        ("2026-05-27T12:30:00+02:00", 0),
        ("2026-05-27T10:30:00.250000Z", 250_000),
        ("20260527T103000Z", 0),
        ("2026-05-27 10:30Z", 0),
        ("2026-05-27T06:00-0430", 0),
        ("2026-W22-3T10:30:00Z", 0),
        ("2026-05-27T10:30:00,1234567Z", 123_456),
        ("2026-05-27T10:30:30+00:00:30", 0),
        ("2026-05-27T10:30:00", None),
        ("2026-05-27", None),
        ("2026", None),
        ("2026-13-27T10:30:00Z", None),
        ("2026-02-30T10:30:00Z", None),
        ("2026-05-27T24:00:00Z", None),
        ("2026-05-27T10:60:00Z", None),
        ("not-a-time", None),
        (" 2026-05-27T10:30:00Z", None),
        ("0000-05-27T10:30:00Z", None),
        ("2026-W54-1T10:30:00Z", None),
        (None, None),
    ],
)
def test_parse_iso(spark, text, micros):
    got = one(spark, F.unix_micros(parse_iso(F.lit(text).cast("string"))))
    assert got == (None if micros is None else 1779877800000000 + micros)


def test_distance(spark):
    d = lambda *a: one(spark, geo.distance_m(*[num(v) for v in a]))
    assert d(0.0, 0.0, 0.0, 1.0) == pytest.approx(111319.49, abs=0.01)
    assert d(0.0, 179.9999, 0.0, -179.9999) == pytest.approx(22.264, abs=0.001)
    assert d(LAT, LON, LAT + 0.0001, LON) == pytest.approx(11.1, abs=0.02)


@pytest.mark.parametrize("lat, lon", [(LAT, LON), (0.0, 179.99995), (0.0, -180.0), (89.9999, 10.0), (-90.0, 0.0), (-33.0, 18.0)])
def test_grid_covers_every_point_within_the_radius(spark, lat, lon):
    """Points on a ring just inside the radius lie in a cell of the search box."""
    r, n = 25.0, 360
    rows = []
    for i in range(n):
        a = 2 * math.pi * i / n
        dlat = 24.8 * math.cos(a) / 111_700
        p = min(90.0, max(-90.0, lat + dlat))
        east = 24.8 * math.sin(a) / (111_700 * max(math.cos(math.radians((lat + p) / 2)), 1e-7))
        q = (lon + max(-180.0, min(180.0, east)) + 180.0) % 360.0 - 180.0
        rows.append((p, q))
    df = spark.createDataFrame(rows, "lat double, lon double")
    near = df.filter(geo.distance_m(num(lat), num(lon), F.col("lat"), F.col("lon")) <= r)
    box = geo.explode_cells(spark.createDataFrame([(lat, lon)], "a double, b double"), "a", "b", r, "cell")
    assert box.count() == box.distinct().count()
    placed = near.withColumn("cell", geo.grid_cell(F.col("lat"), F.col("lon"), r))
    assert placed.count() > 0
    assert placed.join(box, "cell", "left_anti").count() == 0
