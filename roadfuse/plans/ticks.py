"""Queries over stored tables: two ticks of the jobs, with rows that arrive late, on what Spark derives from ``events``.

The first batch holds what was received before ``EARLIER_RUN`` but for every 17th row, which arrives with
the rest in the second one. Every query builds the tables it needs below the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadfuse.model import forest
from roadfuse.model.artifact import ForestNode
from roadfuse.operators import members, pairing, quality, readpath
from roadfuse.operators.idfilter import StoredIds
from roadfuse.operators.ingest import append_new
from roadfuse.plans import jobs, stages
from roadfuse.plans import twins as t
from roadfuse.plans.catalog import _MATCH, _UPSERTED_SQL, _tile_sql, r, register, us
from roadfuse.plans.stages import AS_OF, CFG, EARLIER_RUN, RUN_ID
from roadfuse.session import use_checkpoint_dir
from roadfuse.sources import adapter
from roadfuse.sources.tables import Tables
from roadfuse.streaming import incremental

_TICK = f"CASE WHEN received_us < {t.EARLIER_US} AND event_id % 17 <> 0 THEN 1 ELSE 2 END"
_ARRIVED = f"arrived AS (SELECT client_id, {_TICK} AS tick FROM observation UNION ALL SELECT client_id, {_TICK} FROM frame)"
#: The first tick pairs its frames with the observations of its own batch, the second one with all.
_PAIRED = t.PAIRED.replace(
    "abs(f.ts_us - o.ts_us) < 3000000)",
    f"abs(f.ts_us - o.ts_us) < 3000000 AND (f.client_id IN (SELECT client_id FROM arrived WHERE tick = 2)"
    " OR o.client_id IN (SELECT client_id FROM arrived WHERE tick = 1)))",
)
_TO_PAIRS = (t.SCORED, _ARRIVED, _PAIRED, t.PRIMARY)
_TO_FRESH = (*_TO_PAIRS, t.SITES, t.MEMBERS, t.DBSCAN, t.AGGREGATED)


def _first() -> Column:
    return (F.col("received_at") < F.lit(EARLIER_RUN)) & (F.col("event_id") % 17 != 0)


def new_tables(spark: SparkSession) -> Tables:
    return Tables(spark, f"{use_checkpoint_dir(spark).rstrip('/')}/ticks-{uuid.uuid4().hex}", buckets=8, pages=64)


def _arrive(tables: Tables, sf: str, first: bool) -> None:
    which = _first() if first else ~_first()
    batch = "first" if first else "second"
    tables.append("observation", adapter.observations(tables.spark, sf).filter(which), batch)
    tables.append("frame", adapter.frames(tables.spark, sf).filter(which), batch)


def two_ticks(spark: SparkSession, sf: str) -> Tables:
    """Tables after both fusion ticks, with the model given by hand."""
    tables = new_tables(spark)
    jobs.save_model(tables, stages.FIXED_MODEL, stages.EPOCH)
    _arrive(tables, sf, first=True)
    jobs.run_fusion(tables, CFG, EARLIER_RUN, "run-1")
    _arrive(tables, sf, first=False)
    jobs.run_fusion(tables, CFG, AS_OF, RUN_ID)
    return tables


@register(
    "queue_after_tick",
    t.twin(f"SELECT 'observation' AS source, client_id FROM observation WHERE {_TICK} = 2 UNION ALL SELECT 'frame', client_id FROM frame WHERE {_TICK} = 2"),
)
def queue_after_tick(spark, sf):
    """What the second tick finds open: late rows and new ones, from open batches only."""
    tables = new_tables(spark)
    jobs.save_model(tables, stages.FIXED_MODEL, stages.EPOCH)
    _arrive(tables, sf, first=True)
    jobs.run_fusion(tables, CFG, EARLIER_RUN, "run-1")
    _arrive(tables, sf, first=False)
    out = None
    for source, done in (("observation", "observation_score"), ("frame", "frame_processed")):
        rows = jobs.open_rows(tables, source, done, RUN_ID)[0].select(F.lit(source).alias("source"), "client_id")
        out = rows if out is None else out.union(rows)
    return out


@register(
    "run_fusion_tick",
    t.twin(
        "SELECT p.event_client_id, p.frame_client_id, round(p.fused_confidence, 6) AS fused_confidence, p.delta_ms,"
        f" CASE a.tick WHEN 1 THEN 'run-1' ELSE '{RUN_ID}' END AS fusion_run_id,"
        f" CASE a.tick WHEN 1 THEN {t.EARLIER_US} ELSE {t.AS_OF_US} END AS created_us"
        " FROM prim p JOIN arrived a ON a.client_id = p.frame_client_id",
        *_TO_PAIRS,
    ),
)
def run_fusion_tick(spark, sf):
    """Stored pairs after two ticks."""
    pairs = two_ticks(spark, sf).read("fusion_pair")
    return pairs.select("event_client_id", "frame_client_id", r("fused_confidence"), "delta_ms", "fusion_run_id", us("created_at", "created_us"))


@register(
    "fusion_run_audit",
    t.twin(
        f"SELECT CASE a.tick WHEN 1 THEN 'run-1' ELSE '{RUN_ID}' END AS run_id, count(*) AS inputs_count, count(p.frame_client_id) AS outputs_count,"
        " (SELECT count(*) FROM observation WHERE client_id IN (SELECT client_id FROM arrived b WHERE b.tick = a.tick)) AS scored"
        " FROM frame f JOIN arrived a ON a.client_id = f.client_id LEFT JOIN prim p ON p.frame_client_id = f.client_id GROUP BY a.tick",
        *_TO_PAIRS,
    ),
)
def fusion_run_audit(spark, sf):
    """The audit of both ticks, and the scores and marks each of them stored."""
    tables = two_ticks(spark, sf)
    scored = tables.read("observation_score", partitions=True).groupBy(F.col("batch").alias("run_id")).agg(F.count("*").alias("scored"))
    marked = tables.read("frame_processed", partitions=True).groupBy(F.col("batch").alias("run_id")).agg(F.count("*").alias("marked"))
    runs = tables.read("fusion_run").join(scored, "run_id").join(marked, "run_id")
    return runs.filter("marked = inputs_count").select("run_id", "inputs_count", "outputs_count", "scored")


def _as_stream(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` as a stream of files, with one row at the end that moves the watermark past all others."""
    fields = {"client_id": F.lit("end"), "device_id": F.lit("nobody"), "ts_utc": F.timestamp_seconds(F.lit(4_000_000_000))}
    last = rows.sparkSession.range(1).select(*[fields.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in rows.schema])
    rows.union(last).write.parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(folder)


@register(
    "stream_pairing",
    t.twin(
        "SELECT f.client_id AS frame_client_id, p.event_client_id, round(p.fused_confidence, 6) AS fused_confidence, p.delta_ms"
        " FROM frame f LEFT JOIN prim p ON p.frame_client_id = f.client_id",
        *t.TO_PRIMARY,
    ),
)
def stream_pairing(spark, sf):
    """Outcome of every frame after observations and frames have run through the stream-stream join."""
    tables = new_tables(spark)
    jobs.save_model(tables, stages.FIXED_MODEL, stages.EPOCH)
    observations, frames = adapter.observations(spark, sf), adapter.frames(spark, sf)
    tables.append("observation", observations, "all")
    jobs.score_new(tables, stages.FIXED_MODEL, CFG, stages.EPOCH, "scores")
    place = ["client_id", "device_id", "ts_utc", "lat", "lon", "received_at"]
    incremental.start_interval_pairing(
        _as_stream(frames.select(*place, "device_probability"), f"{tables.root}/frame-stream"),
        _as_stream(observations.select(*place, *pairing.SENSOR_COLUMNS), f"{tables.root}/observation-stream"),
        tables,
        CFG,
        f"{tables.root}/stream-state",
        clock=lambda: AS_OF,
    ).awaitTermination()
    settled = tables.read("frame_processed").select(F.col("client_id").alias("frame_client_id"))
    pairs = tables.read("fusion_pair").select("frame_client_id", "event_client_id", r("fused_confidence"), "delta_ms")
    return settled.join(pairs, "frame_client_id", "left")


@register(
    "max_fused_window",
    t.twin(
        "SELECT event_client_id AS client_id, round(max(fused_confidence), 6) AS max_fused FROM prim JOIN observation ON client_id = event_client_id"
        f" WHERE received_us // 86400000000 >= {t.AS_OF_US} // 86400000000 - 30 GROUP BY 1",
        *_TO_PAIRS,
    ),
)
def max_fused_window(spark, sf):
    """Best pair of the observations of 30 days, merged from the maxima stored by day and bucket."""
    import datetime

    fused = jobs.fused_since(two_ticks(spark, sf), AS_OF - datetime.timedelta(days=30))
    return members.best_fused(fused).select("client_id", r("max_fused"))


def _clustered(spark: SparkSession, sf: str) -> Tables:
    tables = two_ticks(spark, sf)
    sites, links = stages.site_clusters(spark, sf), stages.site_links(spark, sf)
    jobs.store_clusters(tables, sites, links)
    jobs.run_clustering(tables, CFG, AS_OF, RUN_ID)
    return tables


@register("run_clustering_tick", t.twin(_UPSERTED_SQL, *_TO_FRESH, _MATCH))
def run_clustering_tick(spark, sf):
    """Stored clusters after a clustering run over what two ticks stored."""
    return _clustered(spark, sf).read("cluster").select(
        "cluster_id", r("severity"), "observation_count", "source",
        F.coalesce(F.unix_micros("repaired_at"), F.lit(0)).alias("repaired_us"),
        us("created_at", "created_us"), us("updated_at", "updated_us"),
    )


@register(
    "run_clustering_links",
    t.twin(
        "SELECT cluster_id, member_id, kind, round(fused_confidence, 6) AS fused_confidence FROM site_link"
        " WHERE cluster_id NOT IN (SELECT cluster_id FROM mapped) UNION ALL"
        " SELECT m.cluster_id, l.client_id, 'observation', round(l.confidence, 6) FROM labelled l JOIN mapped m ON m.label = l.label",
        *_TO_FRESH, _MATCH, t.SITE_LINKS,
    ),
)
def run_clustering_links(spark, sf):
    """The links that the same commit stored."""
    return _clustered(spark, sf).read("cluster_link").select("cluster_id", "member_id", "kind", r("fused_confidence"))


_GONE = "(SELECT client_id FROM {} WHERE device_id = 'dev-7')"


@register(
    "delete_device_stored",
    t.twin(
        "SELECT 'observation' AS tbl, client_id FROM observation WHERE device_id <> 'dev-7'"
        " UNION ALL SELECT 'frame', client_id FROM frame WHERE device_id <> 'dev-7'"
        " UNION ALL SELECT 'observation_score', client_id FROM observation WHERE device_id <> 'dev-7'"
        " UNION ALL SELECT 'frame_processed', client_id FROM frame WHERE device_id <> 'dev-7'"
        f" UNION ALL SELECT 'cluster_link', member_id FROM site_link WHERE member_id NOT IN {_GONE.format('observation')}"
        f" UNION ALL SELECT 'fusion_pair', frame_client_id FROM prim WHERE event_client_id NOT IN {_GONE.format('observation')}"
        f" AND frame_client_id NOT IN {_GONE.format('frame')}"
        f" UNION ALL SELECT DISTINCT 'fused_max', event_client_id FROM prim WHERE event_client_id NOT IN {_GONE.format('observation')}"
        f" AND frame_client_id NOT IN {_GONE.format('frame')}"
        " UNION ALL SELECT DISTINCT 'device_rate_limit', device_id FROM observation WHERE device_id <> 'dev-7'",
        *_TO_PAIRS, t.SITE_LINKS,
    ),
)
def delete_device_stored(spark, sf):
    """What every stored table holds once a device is removed with all that hangs on it."""
    tables = two_ticks(spark, sf)
    jobs.store_clusters(tables, stages.site_clusters(spark, sf), stages.site_links(spark, sf))
    counts = adapter.observations(spark, sf).groupBy("device_id").agg(F.count("*").alias("request_count"), F.min("received_at").alias("window_start"))
    tables.append("device_rate_limit", counts.withColumn("resource", F.lit("events")), "all")
    jobs.delete_device(tables, "dev-7")
    ids = {"cluster_link": "member_id", "fusion_pair": "frame_client_id", "device_rate_limit": "device_id"}
    out = None
    for name in ("observation", "frame", "observation_score", "frame_processed", "cluster_link", "fusion_pair", "fused_max", "device_rate_limit"):
        rows = tables.read(name).select(F.lit(name).alias("tbl"), F.col(ids.get(name, "client_id")).alias("client_id"))
        out = (rows if out is None else out.union(rows))
    single = F.col("tbl").isin("fused_max", "device_rate_limit")
    return out.filter(~single).union(out.filter(single).distinct())


@register(
    "clear_missing_runs",
    t.twin(
        f"SELECT p.event_client_id, p.frame_client_id, CASE a.tick WHEN 2 THEN '{RUN_ID}' END AS fusion_run_id"
        " FROM prim p JOIN arrived a ON a.client_id = p.frame_client_id",
        *_TO_PAIRS,
    ),
)
def clear_missing_runs(spark, sf):
    """Pairs whose run the audit no longer holds: the first tick's is taken out of it by hand."""
    tables = two_ticks(spark, sf)
    runs = tables.read("fusion_run", partitions=True).filter("run_id = 'run-1'")
    tables.remove_rows("fusion_run", runs.select("run_id"), [(b.batch, None) for b in runs.select("batch").collect()], "run_id")
    jobs.clear_missing_runs(tables)
    return tables.read("fusion_pair").select("event_client_id", "frame_client_id", "fusion_run_id")


@register(
    "append_new_stored",
    t.twin(
        "SELECT client_id, attempt FROM (SELECT client_id, received_us, 2 AS attempt FROM observation UNION ALL"
        " SELECT 'new-' || client_id, received_us, 1 FROM observation WHERE event_id % 5 = 0)"
        f" WHERE client_id LIKE 'new-%' OR client_id NOT IN (SELECT client_id FROM observation WHERE {_TICK} = 1)"
    ),
)
def append_new_stored(spark, sf):
    """Insert-if-absent against stored ids, through their filters: everything is sent again, with new ids among it."""
    tables = new_tables(spark)
    rows = adapter.observations(spark, sf)
    tables.append("observation", rows.filter(_first()), "first")
    again = rows.select("client_id", "received_us", F.lit(2).alias("attempt"))
    fresh = rows.filter("event_id % 5 = 0").select(F.concat(F.lit("new-"), "client_id").alias("client_id"), "received_us", F.lit(1).alias("attempt"))
    sent = again.union(fresh)
    return append_new(sent, StoredIds(tables, "observation"), "client_id", ["received_us", "attempt"]).select("client_id", "attempt")


@register(
    "zoom_tiles_stored",
    t.twin(
        "SELECT 'pothole' AS asset_type, z, x, y, count(*) AS clusters, cast(sum(observation_count) AS bigint) AS observations,"
        " round(max(severity), 6) AS max_severity, round(avg(lat), 6) AS lat FROM ("
        + " UNION ALL ".join(
            f"SELECT {z} AS z, {_tile_sql(z)}, observation_count, severity, lat FROM site_cluster WHERE repaired_us IS NULL AND cluster_id <> 'clu_001'"
            for z in readpath.TILE_ZOOMS
        )
        + ") GROUP BY z, x, y",
        t.SITES,
    ),
)
def zoom_tiles_stored(spark, sf):
    """Tiles from the sums stored with the clusters, after one of them was repaired."""
    tables = new_tables(spark)
    jobs.store_clusters(tables, stages.site_clusters(spark, sf), stages.site_links(spark, sf))
    jobs.mark_repaired(tables, stages.site_clusters(spark, sf).filter("cluster_id = 'clu_001'"), AS_OF)
    return jobs.stored_tiles(tables).select("asset_type", "z", "x", "y", "clusters", "observations", r("max_severity"), r("lat"))


_NUMBER = "cast(substr({}, 2) AS bigint)"
_FLAWED = f"""
bad_observation AS (
  SELECT client_id, CASE WHEN event_id % 103 = 0 THEN NULL ELSE lat END AS lat FROM observation
  UNION ALL SELECT client_id, lat FROM observation WHERE event_id % 101 = 0),
bad_frame AS (
  SELECT client_id, event_id % 89 = 0 AS without_url FROM frame UNION ALL SELECT client_id, false FROM frame WHERE event_id % 97 = 0),
cold_number AS (SELECT *, {_NUMBER.format('frame_client_id')} AS k FROM cold),
bad_pair AS (
  SELECT CASE WHEN k % 3 = 0 THEN 'x' ELSE '' END || event_client_id AS e, CASE WHEN k % 4 = 0 THEN 'x' ELSE '' END || frame_client_id AS f FROM cold_number
  UNION ALL SELECT event_client_id, frame_client_id FROM cold_number WHERE k % 5 = 1 AND k % 3 > 0 AND k % 4 > 0),
bad_cluster AS (
  SELECT cluster_id, CASE WHEN observation_count % 4 = 0 THEN 'other' ELSE source END AS source FROM site_cluster
  UNION ALL SELECT cluster_id, source FROM site_cluster WHERE distinct_devices = 2),
link_number AS (SELECT *, {_NUMBER.format('member_id')} AS k FROM site_link),
bad_link AS (
  SELECT CASE WHEN k % 19 = 0 THEN 'none' ELSE cluster_id END AS cluster_id, member_id, CASE WHEN k % 17 = 0 THEN 'other' ELSE kind END AS kind FROM link_number
  UNION ALL SELECT cluster_id, member_id, kind FROM link_number WHERE k % 13 = 0 AND k % 17 > 0 AND k % 19 > 0)"""


def _flawed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Tables that break every check."""
    k = lambda c: F.expr(f"cast(substr({c}, 2) as bigint)")
    x = lambda c, n: F.concat(F.when(k("frame_client_id") % n == 0, F.lit("x")).otherwise(F.lit("")), c)
    rows, frames = adapter.observations(spark, sf), adapter.frames(spark, sf)
    pairs, sites, links = stages.fused(spark, sf, with_model=False), stages.site_clusters(spark, sf), stages.site_links(spark, sf)
    n, m = k("frame_client_id"), k("member_id")
    return {
        "observation": rows.withColumn("lat", F.when(F.col("event_id") % 103 != 0, F.col("lat"))).unionByName(rows.filter("event_id % 101 = 0")),
        "frame": frames.withColumn("jpeg_url", F.when(F.col("event_id") % 89 != 0, F.col("jpeg_url"))).unionByName(frames.filter("event_id % 97 = 0")),
        "fusion_pair": pairs.withColumns({"event_client_id": x("event_client_id", 3), "frame_client_id": x("frame_client_id", 4)}).unionByName(
            pairs.filter((n % 5 == 1) & (n % 3 > 0) & (n % 4 > 0))
        ),
        "cluster": sites.withColumn("source", F.when(F.col("observation_count") % 4 == 0, F.lit("other")).otherwise(F.col("source"))).unionByName(
            sites.filter("distinct_devices = 2")
        ),
        "cluster_link": links.withColumns(
            {"cluster_id": F.when(m % 19 == 0, F.lit("none")).otherwise(F.col("cluster_id")), "kind": F.when(m % 17 == 0, F.lit("other")).otherwise(F.col("kind"))}
        ).unionByName(links.filter((m % 13 == 0) & (m % 17 > 0) & (m % 19 > 0))),
    }


@register(
    "integrity_checks_broken",
    t.twin(
        "SELECT 'observation_key' AS check_name, count(*) AS violations FROM (SELECT client_id FROM bad_observation GROUP BY 1 HAVING count(*) > 1)"
        " UNION ALL SELECT 'observation_required', count(*) FROM bad_observation WHERE lat IS NULL"
        " UNION ALL SELECT 'frame_key', count(*) FROM (SELECT client_id FROM bad_frame GROUP BY 1 HAVING count(*) > 1)"
        " UNION ALL SELECT 'frame_required', count(*) FROM bad_frame WHERE without_url"
        " UNION ALL SELECT 'pair_key', count(*) FROM (SELECT e, f FROM bad_pair GROUP BY 1, 2 HAVING count(*) > 1)"
        " UNION ALL SELECT 'pair_observation', count(*) FROM bad_pair WHERE e NOT IN (SELECT client_id FROM observation)"
        " UNION ALL SELECT 'pair_frame', count(*) FROM bad_pair WHERE f NOT IN (SELECT client_id FROM frame)"
        " UNION ALL SELECT 'cluster_key', count(*) FROM (SELECT cluster_id FROM bad_cluster GROUP BY 1 HAVING count(*) > 1)"
        " UNION ALL SELECT 'cluster_source', count(*) FROM bad_cluster WHERE source = 'other'"
        " UNION ALL SELECT 'link_key', count(*) FROM (SELECT cluster_id, member_id, kind FROM bad_link GROUP BY 1, 2, 3 HAVING count(*) > 1)"
        " UNION ALL SELECT 'link_kind', count(*) FROM bad_link WHERE kind = 'other'"
        " UNION ALL SELECT 'link_cluster', count(*) FROM bad_link WHERE cluster_id NOT IN (SELECT cluster_id FROM site_cluster)",
        *t.TO_COLD, t.SITES, t.SITE_LINKS, _FLAWED,
    ),
)
def integrity_checks_broken(spark, sf):
    """Every integrity check over tables that break it; the rules about single rows of a table share one pass."""
    return quality.integrity_counts(_flawed(spark, sf))


#: Two trees given by hand: (tree, node, feature, threshold, left, right, path length).
_FOREST = (
    (0, 0, 0, 4.0, 1, 2, 0.0), (0, 1, 4, 10.0, 3, 4, 0.0), (0, 2, -1, 0.0, 2, 2, 1.5), (0, 3, -1, 0.0, 3, 3, 3.0), (0, 4, -1, 0.0, 4, 4, 4.25),
    (1, 0, 2, 30.0, 1, 2, 0.0), (1, 1, -1, 0.0, 1, 1, 3.5), (1, 2, 3, 1.0, 3, 4, 0.0), (1, 3, -1, 0.0, 3, 3, 2.0), (1, 4, -1, 0.0, 4, 4, 2.5),
)
_PATHS = (
    f"((CASE WHEN {t.RATIO} >= 4 THEN 1.5 WHEN speed_mps < 10 THEN 3.0 ELSE 4.25 END)"
    " + (CASE WHEN magnitude < 30 THEN 3.5 WHEN accel_std < 1 THEN 2.0 ELSE 2.5 END)) / 2"
)


@register(
    "score_fixed_forest",
    t.twin(f"SELECT client_id, round(pow(cast(2 AS double), -({_PATHS}) / (2 * (ln(7) + 0.5772156649015329) - 2 * 7 / cast(8 AS double))), 9) AS score FROM observation"),
)
def score_fixed_forest(spark, sf):
    """Anomaly scores of a forest given by hand; its nodes are written as CASE in the twin."""
    rows = adapter.observations(spark, sf)
    nodes = tuple(ForestNode(*n) for n in _FOREST)
    return rows.select("client_id", r(forest.anomaly_score(rows, nodes, 8), 9, "score"))
