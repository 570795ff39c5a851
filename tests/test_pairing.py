import random

import pytest
from rows import LAT, LON, at, frame, observation, table
from pyspark.sql import functions as F

from roadfuse.functions import geo
from roadfuse.operators import pairing


def pair(spark, frames, observations, **kw):
    got = pairing.nearest_observation(table(spark, "frame", frames), table(spark, "observation", observations), **kw)
    return {r.frame_client_id: r for r in got.collect()}


def test_nearest_in_time_of_the_same_device(spark):
    got = pair(
        spark,
        [frame("f", ts_utc=at(0.5)), frame("lonely", device_id="dev-2")],
        [observation("near"), observation("late", ts_utc=at(10.5)), observation("close", ts_utc=at(1.4))],
    )
    assert set(got) == {"f"}
    assert (got["f"].event_client_id, got["f"].delta_ms) == ("near", 500)


def test_bounds(spark):
    """Exactly the time window is out; one microsecond less is in; distance is inclusive."""
    assert not pair(spark, [frame("f", ts_utc=at(3.0))], [observation("o")])
    assert pair(spark, [frame("f", ts_utc=at(2.999999))], [observation("o")])["f"].delta_ms == 3000
    d = spark.range(1).select(geo.distance_m(*[F.lit(v) for v in (LAT, LON, LAT + 0.0002, LON)]).alias("d")).first().d
    args = [frame("f", lat=LAT + 0.0002)], [observation("o")]
    assert pair(spark, *args, window_m=d)["f"].delta_m == d
    assert not pair(spark, *args, window_m=d - 1e-9)


@pytest.mark.parametrize("us, want", [(2500, 3), (-2500, -3), (1499, 1), (-1499, -1), (500, 1), (0, 0)])
def test_whole_ms_rounds_halves_away_from_zero(spark, us, want):
    assert spark.range(1).select(pairing.whole_ms(F.lit(us).cast("long")).alias("v")).first().v == want


def test_ties_and_copies(spark):
    rows = [observation(i) for i in ("c", "a", "b")] + [observation("0far", lat=LAT + 0.0001)]
    assert pair(spark, [frame("f")], rows)["f"].event_client_id == "a"


def test_antimeridian(spark):
    got = pair(spark, [frame("f", lat=0.0, lon=179.99995)], [observation("o", lat=0.0, lon=-179.99995)])
    assert got["f"].delta_m == pytest.approx(11.13, abs=0.01)


def test_equals_brute_force_for_any_partitioning(spark):
    rnd = random.Random(5)

    def place():
        return dict(device_id=f"d{min(rnd.randrange(4), 1)}", ts_utc=at(rnd.uniform(0, 40)),
                    lat=LAT + rnd.uniform(-4e-4, 4e-4), lon=LON + rnd.uniform(-4e-4, 4e-4))

    frames = table(spark, "frame", [frame(f"f{i}", **place()) for i in range(150)])
    obs = table(spark, "observation", [observation(f"o{i}", **place()) for i in range(300)])
    f, o = frames.alias("f"), obs.alias("o")
    every = f.crossJoin(o).filter("f.device_id = o.device_id").select(
        F.col("f.client_id").alias("f"), F.col("o.client_id").alias("o"),
        (F.unix_micros("f.ts_utc") - F.unix_micros("o.ts_utc")).alias("us"),
        geo.distance_m(F.col("f.lat"), F.col("f.lon"), F.col("o.lat"), F.col("o.lon")).alias("m"),
    )
    want = {}
    for r in every.filter("abs(us) < 3000000 and m <= 25").collect():
        key = (abs(r.us), r.m, r.o)
        want[r.f] = min(want.get(r.f, key), key)
    for n, first in ((1, ()), (13, ()), (5, (20, 400))):
        got = pairing.nearest_observation(frames.repartition(n), obs.repartition(n), first_ms=first)
        assert {r.frame_client_id: r.event_client_id for r in got.collect()} == {k: v[2] for k, v in want.items()}


def test_observations_are_cut_to_the_span_of_the_frames(spark):
    frames = table(spark, "frame", [frame("f")])
    obs = table(spark, "observation", [observation("in", ts_utc=at(2)), observation("out", ts_utc=at(60))])
    assert [r.client_id for r in pairing.around_frames(frames, obs, 3000).collect()] == ["in"]
    assert pairing.around_frames(frames.limit(0), obs, 3000).count() == 0


def test_dense_steps(spark):
    obs = table(spark, "observation", [observation(f"o{i}", ts_utc=at(i / 100)) for i in range(300)])
    assert pairing.dense_steps(obs, 3000, 25.0) == ()
    assert pairing.dense_steps(obs, 3000, 25.0, spots_per_key=50) == (375,)
    assert pairing.dense_steps(obs, 3000, 25.0, spots_per_key=5) == (46, 375)
