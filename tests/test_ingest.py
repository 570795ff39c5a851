import datetime
import json
from collections import Counter

from rows import BASE, at, observation, table
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.operators import ingest, ratelimit, validate
from roadfuse.schema import empty
from roadfuse.sources import uploads

CFG = Config()


def item(client_id="test-event-001", **kw):
    base = dict(
        client_id=client_id, schema_version=1, ts="2026-05-27T10:30:00Z", lat=43.6532, lon=-79.3832, speed_mps=12.5,
        bearing_deg=180.0, speed_accuracy_mps=1.2, accel_max_g=2.3, accel_std=0.8, magnitude=3.1, confidence=0.95,
    )
    base.update(kw)
    return {k: v for k, v in base.items() if v is not ...}


def request(items, n=0, device="dev-1", version="v1"):
    return json.dumps(
        dict(request_id=f"r{n}", device_id=device, accept_version=version, received_at=at(n).isoformat(), events=items)
    )


def run(spark, texts, existing=None, mode="per_row"):
    envelopes = uploads.observation_envelopes_from_text(spark.createDataFrame([(t,) for t in texts], "value string"))
    return ingest.ingest_observations(envelopes, existing or empty(spark, "observation"), CFG, mode)


BAD = [
    (dict(lat=91.0), "lat"), (dict(lon=-181.0), "lon"), (dict(confidence=1.5), "confidence"),
    (dict(accel_max_g=55.0), "accel_max_g"), (dict(speed_mps=-5.0), "speed_mps"), (dict(ts="not-a-time"), "ts"),
    (dict(magnitude=...), "magnitude"), (dict(client_id=""), "client_id"), (dict(client_id="x" * 65), "client_id"),
    (dict(schema_version=0), "schema_version"), (dict(raw_window_b64="x" * 50_001), "raw_window_b64"),
    (dict(time_in_max=-1.0), "time_in_max"), (dict(frame_client_id="f" * 65), "frame_client_id"),
    (dict(bearing_deg=361.0), "bearing_deg"), (dict(gbar_in_max=501.0), "gbar_in_max"),
]


def test_bad_items_are_quarantined_with_their_reason(spark):
    texts = [request([item(f"ok-{i}"), item(**({"client_id": f"bad-{i}"} | kw))], i) for i, (kw, _) in enumerate(BAD)]
    got = run(spark, texts)
    reasons = {r.request_id: r.reasons for r in got.rejected.collect()}
    assert reasons == {f"r{i}": [why] for i, (_, why) in enumerate(BAD)}
    assert {r.client_id for r in got.accepted.collect()} == {f"ok-{i}" for i in range(len(BAD))}
    assert got.new_rows.count() == len(BAD)


def test_whole_batch_mode_refuses_every_item(spark):
    got = run(spark, [request([item("a"), item("b", lat=91.0)]), request([item("c")], 1)], mode="whole_batch")
    assert {(r.client_id, tuple(r.reasons)) for r in got.rejected.collect()} == {("a", ("batch",)), ("b", ("lat",))}
    assert [r.client_id for r in got.new_rows.collect()] == ["c"]


def test_refused_requests_are_not_parsed_again(spark):
    """All outputs read the cached items, those of requests that are refused as a whole, too."""
    got = run(spark, [request([item("a"), item("b", lat=91.0)]), request([item("c")], 1, version="v2"), "{"])
    leaves = got.rejected._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(i).nodeName() for i in range(leaves.size())} == {"InMemoryRelation"}
    rejected = {(r.request_id, r.pos, r.client_id, tuple(r.reasons)) for r in got.rejected.collect()}
    assert rejected == {("r0", 1, "b", ("lat",)), ("r1", None, None, ("accept_version",)), (None, None, None, ("malformed",))}
    got.checked.unpersist()


def test_envelope_rules(spark):
    texts = [
        request([], 0), request([item(f"m{i}") for i in range(101)], 1), request([item("v")], 2, version="v2"),
        request([item("d")], 3, device="  "), request([item("ok")], 4, device=" dev-9 ", version=" V1 "), "{broken",
    ]
    got = run(spark, texts)
    assert sorted(r.reasons[0] for r in got.rejected.collect()) == [
        "accept_version", "batch_size", "batch_size", "device_id", "malformed",
    ]
    assert [(r.client_id, r.device_id) for r in got.new_rows.collect()] == [("ok", "dev-9")]


def test_nan_is_out_of_range(spark):
    df = spark.range(1).select(F.lit(float("nan")).alias("lat"))
    assert df.select(validate.failures({"lat": validate._required(F.col("lat"), (-90.0, 90.0))}).alias("r")).first().r == ["lat"]


def test_duplicates_are_accepted_but_stored_once(spark):
    stored = table(spark, "observation", [observation("old")])
    texts = [request([item("a", lat=1.0), item("a", lat=2.0), item("old")], 1), request([item("a", lat=3.0), item("b")], 0)]
    got = run(spark, texts, stored)
    assert Counter(r.client_id for r in got.accepted.collect()) == {"a": 3, "old": 1, "b": 1}
    assert {(r.client_id, r.lat) for r in got.new_rows.collect()} == {("a", 3.0), ("b", 43.6532)}
    row = got.new_rows.filter("client_id = 'b'").first()
    assert row.ts_utc.replace(tzinfo=datetime.timezone.utc) == BASE and row.asset_type == "pothole"


def meta(n, **kw):
    base = dict(request_id=f"r{n}", device_id="dev-1", accept_version="v1", received_at=at(n).isoformat(), path=f"/b/{n}",
                client_id=f"f{n}", ts="2026-05-27T10:30:00Z", lat=43.0, lon=-79.0, device_p_on_device=0.8)
    return json.dumps(base | kw)


def test_frames(spark, tmp_path):
    good = bytes.fromhex("FFD8FFE0") + b"x" * 50
    bodies = {0: good, 1: b"", 2: good + b"x" * 200, 3: bytes.fromhex("89504E47"), 4: good, 5: good, 6: good}
    for n, body in bodies.items():
        (tmp_path / str(n)).write_bytes(body)
    blobs = uploads.read_frame_blobs(spark, str(tmp_path))
    texts = [
        meta(n, path=f"file:{tmp_path}/{n}", **kw)
        for n, kw in enumerate(
            [dict(detections=[{"class_id": 1, "bbox": [1, 2]}]), {}, {}, {}, dict(device_p_on_device=1.5),
             dict(detections=[]), dict(detections=["no object"])]
        )
    ] + ["{oops"]
    frames = uploads.frame_metadata_from_text(spark.createDataFrame([(t,) for t in texts], "value string"))
    got = ingest.ingest_frames(frames, blobs, empty(spark, "frame"), Config(max_frame_size_bytes=100, storage_bucket="frames"))
    assert {r.request_id: r.reasons for r in got.rejected.collect()} == {
        "r1": ["empty"], "r2": ["too_large"], "r3": ["bad_magic"], "r4": ["device_p_on_device"],
        "r6": ["detections"], None: ["malformed"],
    }
    rows = {r.client_id: r for r in got.new_rows.collect()}
    assert set(rows) == {"f0", "f5"}
    assert json.loads(rows["f0"].device_detections) == [{"class_id": 1, "bbox": [1, 2]}]
    assert rows["f5"].device_detections is None
    assert rows["f0"].jpeg_url == "frames/dev-1/f0.jpg"


def replay(rows, limit):
    """Bucket-by-bucket replay of the limiter."""
    buckets, out = {}, {}
    for device, us, digest, rid, n in sorted(rows, key=lambda r: (r[1], r[2], r[3])):
        mine = buckets.setdefault(device, {})
        start = us // 60_000_000 * 60
        mine[start] = mine.get(start, 0) + n
        current = sum(c for b, c in mine.items() if b * 1_000_000 >= us - 3_600_000_000)
        out[rid] = (current, current <= limit)
    return out


def test_rate_limit_equals_replay(spark):
    import hashlib
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(1500):
        second = rnd.choice([rnd.uniform(0, 9000), rnd.randrange(0, 150) * 60, 4000.0])
        us = 1779877800000000 + int(second * 1e6)
        rows.append((f"d{min(rnd.randrange(6), 3)}", us, hashlib.md5(f"q{i}".encode()).hexdigest(), f"q{i}", rnd.randrange(1, 4)))
    df = spark.createDataFrame([(d, "events", rid, us, n) for d, us, _, rid, n in rows],
                               "device_id string, resource string, request_id string, us long, n long")
    df = df.withColumn("received_at", F.timestamp_micros("us")).drop("us").repartition(7)
    got = ratelimit.check_rate_limit(df, {"events": 100})
    assert {r.request_id: (r.current, r.allowed) for r in got.collect()} == replay(rows, 100)


def test_rate_limit_sixth_request_is_refused_and_counts(spark):
    rows = [("dev", "events", f"q{i}", at(i), 1) for i in range(6)] + [("dev", "other", "x", at(0), 1)]
    df = spark.createDataFrame(rows, "device_id string, resource string, request_id string, received_at timestamp, n long")
    got = {r.request_id: (r.current, r.allowed) for r in ratelimit.check_rate_limit(df, {"events": 5}).collect()}
    assert got["q4"] == (5, True) and got["q5"] == (6, False) and got["x"][1]
