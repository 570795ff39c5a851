import datetime
import json

from rows import at, frame, observation, table
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.operators import pairing, ratelimit
from roadfuse.plans import catalog, jobs, stages
from roadfuse.schema import table_schema
from roadfuse.sources import adapter
from roadfuse.sources.tables import Tables
from roadfuse.streaming import incremental
from roadfuse.streaming.intervaljoin import interval_pairs

CFG = Config()
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def in_files(df, folder, order, n=4):
    """Writes ``df`` as n files in ``order``, for a stream of n micro-batches."""
    bounds = [r[0] for r in df.select(F.percentile(order, F.array(*[F.lit(i / n) for i in range(1, n)]))).collect()][0]
    part = sum((F.when(F.col(order) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    for i in range(n):
        df.filter(part == i).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ingest_stream_with_limit_and_repeats(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))

    def text(n, ids, device="dev-1"):
        item = dict(ts="2026-05-27T10:30:00Z", lat=43.0, lon=-79.0, speed_mps=1.0, bearing_deg=0.0,
                    accel_max_g=0.0, accel_std=1.0, magnitude=1.0, confidence=1.0)
        events = [dict(item, client_id=i) for i in ids]
        return json.dumps(dict(request_id=f"r{n}", device_id=device, accept_version="v1", received_at=at(n).isoformat(), events=events))

    source = tmp_path / "in"
    batches = [
        [text(0, ["a", "b"]), text(1, ["c", "bad" * 30])],
        [text(2, ["a", "d"]), text(3, ["e"], "dev-2")],
        [text(4, ["f"]), "{not json", text(5, ["g"]).replace('"v1"', '"v9"')],
    ]
    for i, lines in enumerate(batches):
        spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.mode("append").text(str(source))
        q = incremental.start_observation_ingest(
            spark.readStream.text(str(source)), tables, Config(rate_limit_events_per_hour=6), str(tmp_path / "c")
        )
        q.awaitTermination()
    # dev-1 has used 6 of 6 after the second batch; its seventh item is refused.
    assert sorted(r.client_id for r in tables.read("observation").collect()) == ["a", "b", "c", "d", "e"]
    # Every upload has one outcome.
    accepted = [(r.request_id, r.client_id) for r in tables.read("ingest_accepted").collect()]
    rejected = {(r.request_id, r.client_id): tuple(r.reasons) for r in tables.read("ingest_rejected").collect()}
    assert sorted(accepted) == [("r0", "a"), ("r0", "b"), ("r1", "c"), ("r2", "a"), ("r2", "d"), ("r3", "e")]
    assert rejected == {
        ("r1", "bad" * 30): ("client_id",), ("r4", None): ("rate_limited",), (None, None): ("malformed",), ("r5", None): ("accept_version",),
    }
    assert {r.device_id: r.n for r in tables.read("device_rate_limit").groupBy("device_id").agg(F.sum("request_count").alias("n")).collect()} == {"dev-1": 7, "dev-2": 1}


def test_frame_stream_limits_and_checks_blobs(spark, tmp_path):
    tables, folder = Tables(spark, str(tmp_path / "t")), tmp_path / "blobs"
    folder.mkdir()
    jpeg = bytes([0xFF, 0xD8, 0xFF])
    for name, content in {"ok": jpeg + b"x", "big": jpeg + b"x" * 500, "text": b"hello", "empty": b"", "late": jpeg}.items():
        (folder / f"{name}.jpg").write_bytes(content)

    def text(n, name):
        return json.dumps(dict(
            request_id=f"r{n}", device_id="dev-1", accept_version="v1", received_at=at(n).isoformat(), path=f"file:{folder}/{name}.jpg",
            client_id=name, ts="2026-05-27T10:30:00Z", lat=43.0, lon=-79.0, device_p_on_device=0.5,
        ))

    source = tmp_path / "in"
    lines = [text(i, name) for i, name in enumerate(["ok", "big", "text", "empty", "absent", "late"])]
    spark.createDataFrame([(v,) for v in lines], "value string").coalesce(1).write.text(str(source))
    cfg = Config(rate_limit_frames_per_hour=5, max_frame_size_bytes=100)
    incremental.start_frame_ingest(spark.readStream.text(str(source)), str(folder), tables, cfg, str(tmp_path / "c")).awaitTermination()
    assert [(r.client_id, r.jpeg_bytes) for r in tables.read("frame").collect()] == [("ok", 4)]
    assert [r.client_id for r in tables.read("ingest_accepted").collect()] == ["ok"]
    reasons = {r.request_id: tuple(r.reasons) for r in tables.read("ingest_rejected").collect()}
    assert reasons == {"r1": ("too_large",), "r2": ("bad_magic",), "r3": ("empty",), "r4": ("empty",), "r5": ("rate_limited",)}


def test_blob_heads_are_read_below_the_limit_only(spark, tmp_path):
    from roadfuse.sources import uploads

    for n in (0, 2, 50, 51):
        (tmp_path / f"{n}.jpg").write_bytes(b"abc"[:n] + b"." * max(0, n - 3))
    heads = uploads.read_frame_blobs(spark, str(tmp_path), 50)
    # Spark lists no empty files; ingest counts a missing blob as empty.
    assert {r.length: r.head and bytes(r.head) for r in heads.collect()} == {2: b"ab", 50: b"abc", 51: None}
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,50)" in plan


def test_rate_limit_stream_equals_batch_and_replays(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    requests = catalog.requests(spark, SF)
    folder = in_files(requests.withColumn("us", F.unix_micros("received_at")), tmp_path / "in", "us")
    schema = spark.read.parquet(folder).drop("us").schema
    cfg = Config(rate_limit_events_per_hour=20, rate_limit_frames_per_hour=5)
    incremental.start_rate_limit(stream(spark, folder, schema), tables, cfg, str(tmp_path / "c")).awaitTermination()
    want = ratelimit.check_rate_limit(requests, {"events": 20, "frames": 5})
    got = tables.read("rate_limit_decision")
    cols = ["request_id", "current", "allowed"]
    assert rows_of(got.select(*cols)) == rows_of(want.select(*cols))
    # A repeated batch does not count its own requests twice.
    last = tables.batches("device_rate_limit")[-1]
    before = tables.read("device_rate_limit").agg(F.sum("request_count")).first()[0]
    late = requests.join(got.select("request_id"), "request_id").filter(F.col("received_at") >= F.lit(at(-1e9))).limit(0)
    jobs.decide(late, tables, cfg, "extra")
    assert tables.read("device_rate_limit").agg(F.sum("request_count")).first()[0] == before and last.startswith("rate-limit-")


def test_scoring_and_pairing_streams_equal_batch(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    observations, frames = adapter.observations(spark, SF), adapter.frames(spark, SF)
    tables.append("observation", observations, "all")
    jobs.save_model(tables, stages.FIXED_MODEL, stages.EPOCH)
    clock = lambda: stages.EPOCH
    obs_in = in_files(tables.read("observation").withColumn("us", F.unix_micros("received_at")), tmp_path / "o", "us")
    incremental.start_scoring(stream(spark, obs_in, table_schema("observation")), tables, str(tmp_path / "c1"), clock=clock).awaitTermination()
    want = stages.scores(spark, SF)
    assert rows_of(tables.read("observation_score")) == rows_of(want)

    frame_in = in_files(frames.select(*table_schema("frame").names, F.col("received_us").alias("us")), tmp_path / "f", "us")
    source = stream(spark, frame_in, table_schema("frame"))
    incremental.start_pairing(source, tables, CFG, str(tmp_path / "c2"), clock=clock).awaitTermination()
    cols = ["event_client_id", "frame_client_id", "fused_confidence", "delta_ms", "delta_m"]
    assert rows_of(tables.read("fusion_pair").select(*cols)) == rows_of(stages.fused(spark, SF, True).select(*cols))
    assert tables.read("frame_processed").count() == frames.count()
    assert tables.read("fusion_run").count() == 4


def test_interval_join_equals_batch(spark, tmp_path):
    observations = adapter.observations(spark, SF).select("client_id", "device_id", "ts_utc", "lat", "lon", "ts_us")
    frames = adapter.frames(spark, SF).select("client_id", "device_id", "ts_utc", "lat", "lon", "ts_us")
    # One far-future row per side moves the watermark past all data.
    end = [("end", "nobody", at(86400), 0.0, 0.0, 2_000_000_000_000_000)]
    extra = spark.createDataFrame(end, frames.schema)
    fs = in_files(frames.union(extra), tmp_path / "f", "ts_us", 3)
    os_ = in_files(observations.union(extra), tmp_path / "o", "ts_us", 3)
    pairs = interval_pairs(stream(spark, fs, frames.schema), stream(spark, os_, frames.schema), 3000, 25.0, "5 minutes")
    q = pairs.writeStream.format("memory").queryName("interval").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = pairing.nearest_observation(frames, observations)
    cols = ["frame_client_id", "event_client_id", "delta_ms", "delta_m"]
    assert rows_of(spark.table("interval").filter("frame_client_id <> 'end'").select(*cols)) == rows_of(want.select(*cols))


def test_interval_pairing_settles_every_frame_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    # Per frame: observations in both windows, ties in time, too far in time, too far in space, another device, none.
    observations = [
        observation("o1", ts_utc=at(1)), observation("o2", ts_utc=at(-1), lat=43.65321), observation("o3", ts_utc=at(100.5)),
        observation("o4", ts_utc=at(204)), observation("o5", ts_utc=at(300), lat=43.7), observation("o6", ts_utc=at(400), device_id="dev-2"),
        observation("end", device_id="nobody", ts_utc=at(86400)),
    ]
    frames = [frame(f"f{i}", ts_utc=at(i * 100)) for i in range(6)] + [frame("end", device_id="nobody", ts_utc=at(86400))]
    late = [observation("o0", ts_utc=at(500.25), device_id="dev-1")]
    obs, frm, clock = tmp_path / "o", tmp_path / "f", lambda: stages.EPOCH

    def run():
        q = incremental.start_interval_pairing(
            spark.readStream.schema(table_schema("frame")).parquet(str(frm)), spark.readStream.schema(table_schema("observation")).parquet(str(obs)),
            tables, CFG, str(tmp_path / "c"), clock=clock,
        )
        q.awaitTermination()

    def arrive(name, rows, folder):
        table(spark, name, rows).coalesce(1).write.mode("append").parquet(str(folder))

    arrive("frame", frames[:-1], frm)
    arrive("observation", observations[:-1], obs)
    run()
    # No frame is settled while its observations may still come.
    assert tables.read("frame_processed").filter("client_id > 'f4'").count() == 0
    arrive("observation", late, obs)
    # The batch job took this frame meanwhile; the stream leaves it alone.
    jobs.pair_new(tables, table(spark, "frame", [frames[3]]), None, CFG, stages.EPOCH, "batch")
    run()
    arrive("frame", frames[-1:], frm)
    arrive("observation", observations[-1:], obs)
    run()
    run()
    done = [r.client_id for r in tables.read("frame_processed").collect()]
    assert sorted(done) == [f"f{i}" for i in range(6)]
    pairs = {r.frame_client_id: (r.event_client_id, r.delta_ms) for r in tables.read("fusion_pair").collect()}
    assert pairs == {"f0": ("o1", -1000), "f1": ("o3", -500), "f5": ("o0", -250)}
    assert tables.read("fusion_run").agg(F.sum("inputs_count"), F.sum("outputs_count")).first()[:] == (6, 3)
    # A frame behind the watermark is no outcome of the stream; the stored table keeps it open for the batch job.
    arrive("frame", [frame("f9")], frm)
    run()
    assert tables.read("frame_processed").filter("client_id = 'f9'").count() == 0


def test_drop_repeats(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(5)), ("b", at(1))]
    df = spark.createDataFrame(rows, "client_id string, received_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = incremental.drop_repeats(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "10 minutes")
    q = out.writeStream.format("memory").queryName("repeats").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.client_id for r in spark.table("repeats").collect()) == ["a", "b"]
