"""Incremental jobs: ingest, fit, fusion and clustering over stored tables.

All of them may be repeated: appends are keyed by batch, upserts by row key, and times come
from ``as_of``. Small results (counts, the model, one audit row, names of partitions) are all that reaches the
driver. A tick reads the open batches of its queue and rewrites the partitions its rows fall into.
"""

from __future__ import annotations

import datetime
import logging
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions.fusion import FusionStrategy, select_strategy
from roadfuse.model.artifact import SensorModel, activation_rows, forest_rows, load_active, model_rows
from roadfuse.model.fit import fit_sensor_model, score_observations
from roadfuse.operators import clusters as clustering
from roadfuse.operators import ingest, members, pairing, ratelimit, readpath, reconcile, upsert
from roadfuse.operators.idfilter import StoredIds
from roadfuse.operators.validate import batch_rules, envelope_rules, failures
from roadfuse.schema import table_schema
from roadfuse.session import cut_lineage
from roadfuse.sources.tables import Tables, day_number, day_of, folder_name

log = logging.getLogger(__name__)


def _lit(at: datetime.datetime):
    return F.lit(at).cast("timestamp")


def _audit(tables: Tables, name: str, row: tuple, run_id: str) -> None:
    tables.append(name, tables.spark.createDataFrame([row], table_schema(name)), run_id)


# ── ingest ─────────────────────────────────────────────────────────────────────


def decide(requests: DataFrame, tables: Tables, cfg: Config, batch: str) -> DataFrame:
    """Checks a batch of requests against the hourly limit and stores its bucket counts.

    Only the hour before the batch is read back, and never the batch's own earlier attempt.
    """
    limits = {"events": cfg.rate_limit_events_per_hour, "frames": cfg.rate_limit_frames_per_hour}
    first = requests.agg(F.min("received_at")).first()[0]
    stored = tables.read("device_rate_limit", but_not=batch)
    if first is not None:
        hour = datetime.timedelta(seconds=ratelimit.WINDOW_SECONDS)
        stored = stored.filter(F.col("window_start") >= F.lit(first - hour))
    checked = cut_lineage(ratelimit.check_rate_limit(requests, limits, stored))
    tables.append("device_rate_limit", ratelimit.bucket_counts(requests), batch)
    return checked


def admit(
    uploads: DataFrame, resource: str, items: Column, tables: Tables, cfg: Config, batch: str
) -> tuple[DataFrame, DataFrame]:
    """(uploads within the limit, refused ones as rejections); each counts with its number of items."""
    requests = uploads.select(
        F.trim("device_id").alias("device_id"),
        F.lit(resource).alias("resource"),
        "request_id",
        "received_at",
        items.cast("long").alias("n"),
    )
    decided = decide(requests, tables, cfg, batch)
    refused = decided.filter("not allowed").select("request_id", F.array(F.lit("rate_limited")).alias("reasons"))
    return uploads.join(decided.filter("allowed").select("request_id"), "request_id", "left_semi"), refused


def _within_limit(
    uploads: DataFrame, rules: dict[str, Column], resource: str, items: Column, tables: Tables, cfg: Config, batch: str
) -> tuple[DataFrame, DataFrame]:
    """Malformed and ill-formed requests pass by the limiter, to be rejected by ingest with their own reasons."""
    sound = F.coalesce(F.col("_corrupt").isNull() & (F.size(failures(rules)) == 0), F.lit(False))
    admitted, refused = admit(uploads.filter(sound), resource, items, tables, cfg, batch)
    return admitted.unionByName(uploads.filter(~sound)), refused


def _store(
    result: ingest.IngestResult, refused: DataFrame | None, name: str, resource: str, tables: Tables, batch: str
) -> ingest.IngestResult:
    """Appends new rows and the outcome of every upload: accepted, rejected or refused."""
    rejected = result.rejected
    if refused is not None:
        rejected = rejected.unionByName(refused, allowMissingColumns=True)
    tables.append(name, result.new_rows, batch)
    tables.append("ingest_accepted", result.accepted.withColumn("resource", F.lit(resource)), f"{resource}-{batch}")
    tables.append("ingest_rejected", rejected.withColumn("resource", F.lit(resource)), f"{resource}-{batch}")
    return result._replace(rejected=rejected)


def run_ingest_observations(
    envelopes: DataFrame, tables: Tables, cfg: Config, batch: str, mode: str = "per_row", limited: bool = True
) -> ingest.IngestResult:
    """Limits, validates and appends; stores what became of each upload. The caller unpersists ``checked``."""
    refused = None
    if limited:
        rules = envelope_rules() | batch_rules(cfg)
        envelopes, refused = _within_limit(envelopes, rules, "events", F.size("events"), tables, cfg, batch)
    result = ingest.ingest_observations(envelopes, StoredIds(tables, "observation", batch), cfg, mode)
    return _store(result, refused, "observation", "events", tables, batch)


def run_ingest_frames(
    metadata: DataFrame, blobs: DataFrame, tables: Tables, cfg: Config, batch: str, limited: bool = True
) -> ingest.IngestResult:
    """As for observations; a frame counts once."""
    refused = None
    if limited:
        metadata, refused = _within_limit(metadata, envelope_rules(), "frames", F.lit(1), tables, cfg, batch)
    result = ingest.ingest_frames(metadata, blobs, StoredIds(tables, "frame", batch), cfg)
    return _store(result, refused, "frame", "frames", tables, batch)


# ── model ──────────────────────────────────────────────────────────────────────


def active_model(tables: Tables) -> SensorModel | None:
    return load_active(
        tables.read("sensor_model"), tables.read("sensor_forest"), tables.read("model_activation")
    )


def save_model(tables: Tables, model: SensorModel, at: datetime.datetime) -> None:
    """Stores the model, then activates it: the activation row is the switch."""
    spark = tables.spark
    tables.append("sensor_model", model_rows(spark, model, at), model.version)
    tables.append("sensor_forest", forest_rows(spark, model), model.version)
    activate(tables, model.version, at)


def activate(tables: Tables, version: str, at: datetime.datetime) -> None:
    """Also the way back to an earlier model."""
    tables.append("model_activation", activation_rows(tables.spark, version, at), f"{at:%Y%m%dT%H%M%S%f}-{version}")


def run_fit(tables: Tables, cfg: Config, as_of: datetime.datetime) -> str | None:
    model = fit_sensor_model(tables.read("observation"), active_model(tables), cfg)
    if model is None:
        return None
    save_model(tables, model, as_of)
    return model.version


# ── fusion ─────────────────────────────────────────────────────────────────────


def oldest(rows: DataFrame, n: int | None) -> DataFrame:
    """The work queue in arrival order; without a cap the whole backlog is taken."""
    return rows if n is None else rows.orderBy("received_at", "client_id").limit(n)


def unscored(observations: DataFrame, scores: DataFrame, n: int | None = None) -> DataFrame:
    return oldest(observations.join(scores.select("client_id"), "client_id", "left_anti"), n)


def unprocessed(frames: DataFrame, processed: DataFrame, n: int | None = None) -> DataFrame:
    return oldest(frames.join(processed.select("client_id"), "client_id", "left_anti"), n)


def days_of(rows: DataFrame) -> list[int]:
    """The days on which ``rows`` arrived."""
    return [r.day for r in rows.select(day_of("received_at").alias("day")).distinct().collect()]


def open_rows(tables: Tables, source: str, done: str, run: str) -> tuple[DataFrame | None, list[str]]:
    """(rows of ``source`` without a row in ``done``, the open batches that hold them), with batch and day.

    Reads the folders of open batches, and of ``done`` the days of these. What ``run`` itself did earlier counts as open.
    """
    batches = tables.open_batches(source, f"{run}-{source}")
    if not batches:
        return None, []
    days = sorted({d for of in batches.values() for d in of}, key=str)
    rows = tables.read(source, batches=list(batches), days=days, partitions=True)
    finished = tables.read(done, but_not=run, days=days).select("client_id")
    return rows.join(finished, "client_id", "left_anti"), list(batches)


def close_done(tables: Tables, source: str, rows: DataFrame, taken: DataFrame | None, batches: list[str], run: str) -> None:
    """Closes the open batches of which this run did all rows; ``taken`` is None where it did all of them."""
    left: set[str] = set()
    if taken is not None:
        rest = rows.join(taken.select("client_id"), "client_id", "left_anti")
        left = {r.batch for r in rest.select("batch").distinct().collect()}
    tables.close_batches(source, [b for b in batches if b not in left], run)


def score_new(tables: Tables, model: SensorModel, cfg: Config, as_of: datetime.datetime, batch: str) -> None:
    """Scores the open observations, oldest first."""
    rows, batches = open_rows(tables, "observation", "observation_score", batch)
    if rows is None:
        return
    queue = oldest(rows, cfg.fusion_batch_size)
    tables.append("observation_score", score_observations(queue, model, as_of, keep=("day",)), batch)
    taken = None if cfg.fusion_batch_size is None else tables.read("observation_score", batches=[folder_name(batch)])
    close_done(tables, "observation", rows, taken, batches, batch)


def store_pairs(tables: Tables, pairs: DataFrame) -> None:
    """Upserts pairs (``fusion_pair`` and, where known, the ``day`` of the observation) and the greatest confidence of every observation.

    Only the partitions of these pairs are read and rewritten, both tables in one commit.
    """
    pairs = tables.placed("fusion_pair", pairs)
    at = tables.partitions_of(pairs)
    if not at:
        return
    keys = ["event_client_id", "frame_client_id"]
    merged = upsert.upsert(tables.read_partitions("fusion_pair", at), pairs, keys, ["created_at"])
    best = merged.groupBy("day", "bucket", F.col("event_client_id").alias("client_id")).agg(F.max("fused_confidence").alias("max_fused"))
    tables.rewrite("pairing", {"fusion_pair": merged, "fused_max": best}, at)


def fused_since(tables: Tables, since: datetime.datetime) -> DataFrame:
    """(event_client_id, fused_confidence): the stored maxima of observations that arrived after ``since``; one observation may have several."""
    stored = tables.read("fused_max", since=day_number(since))
    return stored.select(F.col("client_id").alias("event_client_id"), F.col("max_fused").alias("fused_confidence"))


def pair_new(
    tables: Tables,
    frames: DataFrame,
    model: SensorModel | None,
    cfg: Config,
    as_of: datetime.datetime,
    run_id: str,
) -> int:
    """Pairs a batch of frames once, stores the pairs and marks every frame as processed."""
    frames = frames.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_frames = frames.count()
        if not n_frames:
            return 0
        strategy = select_strategy(cfg, model is not None)
        observations = pairing.around_frames(frames, tables.read("observation"), cfg.fusion_window_ms)
        steps = pairing.dense_steps(observations, cfg.fusion_window_ms, cfg.fusion_window_m)
        fused = pairing.pair_and_fuse(
            frames, observations, tables.read("observation_score"), strategy, cfg, steps, keep=("received_at",)
        )
        return _store_run(tables, frames, n_frames, fused, model, strategy, as_of, run_id)
    finally:
        frames.unpersist()


def store_outcomes(
    tables: Tables,
    outcomes: DataFrame,
    model: SensorModel | None,
    cfg: Config,
    as_of: datetime.datetime,
    run_id: str,
) -> int:
    """Fuses and stores frames that a stream has paired already, and marks each of them as processed, paired or not.

    ``outcomes``: a row per frame with ``frame_client_id``, ``frame_received_at``, ``device_probability`` and, null where it has no
    observation, ``event_client_id``, ``event_received_at``, ``delta_ms``, ``delta_m`` and the sensor columns. Only the scores of the
    paired observations' days are read.
    """
    outcomes = outcomes.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n_frames = outcomes.count()
        if not n_frames:
            return 0
        strategy = select_strategy(cfg, model is not None)
        paired = outcomes.filter("event_client_id is not null").withColumnsRenamed(
            {"event_received_at": "received_at", "device_probability": "visual_confidence"}
        )
        scores = tables.read("observation_score", days=days_of(paired))
        fused = pairing.fuse(pairing.with_scores(paired, scores), strategy, keep=("received_at",))
        frames = outcomes.select(F.col("frame_client_id").alias("client_id"), F.col("frame_received_at").alias("received_at"))
        return _store_run(tables, frames, n_frames, fused, model, strategy, as_of, run_id)
    finally:
        outcomes.unpersist()


def _store_run(
    tables: Tables,
    frames: DataFrame,
    n_frames: int,
    fused: DataFrame,
    model: SensorModel | None,
    strategy: FusionStrategy,
    as_of: datetime.datetime,
    run_id: str,
) -> int:
    """Stores the fused pairs of a run, marks all its frames as processed and audits it; the number of pairs."""
    pairs = cut_lineage(
        fused.withColumns({"fusion_run_id": F.lit(run_id), "created_at": _lit(as_of), "day": day_of("received_at")})
    )
    n_pairs = pairs.count()
    store_pairs(tables, pairs)
    tables.append(
        "frame_processed", frames.select("client_id", _lit(as_of).alias("processed_at"), day_of("received_at").alias("day")), run_id
    )
    metrics = (n_frames, n_pairs, model.version if model else None)
    _audit(
        tables,
        "fusion_run",
        (run_id, strategy.version, strategy.weights, as_of, as_of, n_frames, n_pairs, metrics),
        run_id,
    )
    return n_pairs


def run_fusion(tables: Tables, cfg: Config, as_of: datetime.datetime, run_id: str | None = None) -> int:
    """Scores what is unscored (with an active model), then pairs and fuses new frames."""
    run_id = run_id or uuid4().hex
    model = active_model(tables)
    if model is not None:
        score_new(tables, model, cfg, as_of, run_id)
    frames, batches = open_rows(tables, "frame", "frame_processed", run_id)
    if frames is None:
        return 0
    n_pairs = pair_new(tables, oldest(frames, cfg.fusion_batch_size).drop("batch", "day"), model, cfg, as_of, run_id)
    taken = None if cfg.fusion_batch_size is None else tables.read("frame_processed", batches=[folder_name(run_id)])
    close_done(tables, "frame", frames, taken, batches, run_id)
    return n_pairs


# ── clustering ─────────────────────────────────────────────────────────────────


def cluster_rows(aggregated: DataFrame, mapping: DataFrame, as_of: datetime.datetime) -> DataFrame:
    return aggregated.join(mapping, "label").select(
        "cluster_id",
        F.lit("pothole").alias("asset_type"),
        "lat",
        "lon",
        "severity",
        "confidence",
        "observation_count",
        "distinct_devices",
        "last_seen",
        F.lit("crowd").alias("source"),
        F.lit(None).cast("timestamp").alias("repaired_at"),
        _lit(as_of).alias("created_at"),
        _lit(as_of).alias("updated_at"),
    )


def store_clusters(tables: Tables, rows: DataFrame, links: DataFrame) -> None:
    """Upserts clusters, replaces their links and sums up their map tiles anew; all change in one commit, in the buckets of these clusters only."""
    rows, links = tables.placed("cluster", rows), tables.placed("cluster_link", links)
    at = tables.partitions_of(rows)
    clusters = upsert.upsert(tables.read_partitions("cluster", at), rows, ["cluster_id"], ["asset_type", "source", "repaired_at", "created_at"])
    rebuilt = upsert.rebuild_links(tables.read_partitions("cluster_link", at), links)
    parts = readpath.tile_sums(clusters, by=("day", "bucket"))
    tables.rewrite("clusters", {"cluster": clusters, "cluster_link": rebuilt, "tile_part": parts}, at)


def run_clustering(tables: Tables, cfg: Config, as_of: datetime.datetime, run_id: str | None = None) -> int:
    """Clusters recent members into stored clusters; returns how many were written."""
    run_id = run_id or uuid4().hex
    stored = tables.read("cluster")
    since = as_of - datetime.timedelta(days=cfg.cluster_window_days)
    chosen = cut_lineage(
        members.select_members(
            tables.read("observation", since=day_number(since)),
            tables.read("observation_score", since=day_number(since)),
            fused_since(tables, since),
            stored,
            as_of,
            cfg,
        )
    )
    stats = members.member_stats(chosen).first()
    if stats.n < cfg.cluster_min_points:
        return 0
    labelled = clustering.label_members(
        chosen, stats.mean_lat, cfg.cluster_eps_m, cfg.cluster_min_points
    ).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        aggregated = cut_lineage(clustering.aggregate_clusters(labelled))
        mapping = cut_lineage(reconcile.reconcile(aggregated, stored, cfg.cluster_eps_m, run_id))
        written = mapping.count()
        if written:
            rows = cluster_rows(aggregated, mapping, as_of)
            links = clustering.member_rows(labelled).join(mapping.select("label", "cluster_id"), "label").select(
                "cluster_id", "member_id", F.lit("observation").alias("kind"), "fused_confidence"
            )
            store_clusters(tables, rows, links)
    finally:
        labelled.unpersist()
    params = (
        cfg.cluster_eps_m,
        clustering.geo.mercator_eps(cfg.cluster_eps_m, stats.mean_lat),
        cfg.cluster_min_points,
        cfg.cluster_window_days,
        cfg.cluster_member_min_confidence,
        stats.mean_lat,
    )
    _audit(tables, "cluster_run", (run_id, as_of, as_of, stats.n, written, params), run_id)
    log.info("cluster run %s: %d members, %d clusters", run_id, stats.n, written)
    return written


def stored_tiles(tables: Tables) -> DataFrame:
    """Map tiles of all stored clusters, merged from the sums stored by bucket; the clusters themselves aren't read."""
    return readpath.tiles_of(tables.read("tile_part"))


def mark_repaired(tables: Tables, cluster_ids: DataFrame, at: datetime.datetime) -> None:
    """Sets ``repaired_at`` of the given clusters (``cluster_id`` column)."""
    ids = tables.placed("cluster", cluster_ids.select("cluster_id"))
    touched = tables.partitions_of(ids)
    if not touched:
        return
    stored = tables.read_partitions("cluster", touched)
    hit = ids.select("cluster_id", F.lit(True).alias("_hit")).distinct()
    repaired = F.when(F.col("_hit"), _lit(at)).otherwise(F.col("repaired_at"))
    rows = stored.join(hit, "cluster_id", "left").withColumn("repaired_at", repaired).drop("_hit")
    tables.rewrite("clusters", {"cluster": rows, "tile_part": readpath.tile_sums(rows, by=("day", "bucket"))}, touched)


def delete_device(tables: Tables, device_id: str) -> None:
    """Removes a device with all that hangs on it: observations and frames, their scores, marks, ids, pairs and links, and its rate-limit rows.

    Children go before their parents, so an interrupted run finds the parents again when it is repeated. Every table is
    rewritten only in partitions that hold rows to remove; pairs and maxima, clusters and links change together.
    """
    own = F.col("device_id") == device_id
    gone = {name: cut_lineage(tables.read(name, partitions=True).filter(own).select("client_id", "batch", "day")) for name in ("observation", "frame")}
    events, frames = (gone[name].select("client_id") for name in ("observation", "frame"))

    pairs = tables.read("fusion_pair", partitions=True)
    hit = pairs.join(events.withColumnRenamed("client_id", "event_client_id"), "event_client_id", "left_semi").select("day", "bucket")
    hit = hit.union(pairs.join(frames.withColumnRenamed("client_id", "frame_client_id"), "frame_client_id", "left_semi").select("day", "bucket"))
    if at := tables.partitions_of(hit):
        left = tables.read_partitions("fusion_pair", at)
        left = upsert.delete_cascade(events, "client_id", left, "event_client_id")
        left = cut_lineage(upsert.delete_cascade(frames, "client_id", left, "frame_client_id"))
        best = left.groupBy("day", "bucket", F.col("event_client_id").alias("client_id")).agg(F.max("fused_confidence").alias("max_fused"))
        tables.rewrite("pairing", {"fusion_pair": left, "fused_max": best}, at)
    links = tables.read("cluster_link", partitions=True).join(events.withColumnRenamed("client_id", "member_id"), "member_id", "left_semi")
    if at := tables.partitions_of(links):
        left = upsert.delete_cascade(events, "client_id", tables.read_partitions("cluster_link", at), "member_id")
        tables.rewrite("clusters", {"cluster_link": left}, at)

    for child, parents in (("observation_score", events), ("frame_processed", frames)):
        rows = tables.read(child, partitions=True)
        tables.remove_rows(child, parents, [(r.batch, r.day) for r in rows.join(parents, "client_id", "left_semi").select("batch", "day").distinct().collect()])
    tables.remove_rows_where("device_rate_limit", own)
    for name, ids in (("observation", events), ("frame", frames)):
        tables.remove_rows_where(name, own)
        tables.forget_ids(name, ids)


def clear_missing_runs(tables: Tables) -> None:
    """``fusion_run_id`` of pairs becomes null where the audit no longer holds the run; only partitions with such pairs are rewritten."""
    pairs, runs = tables.read("fusion_pair", partitions=True), tables.read("fusion_run")
    orphans = pairs.filter("fusion_run_id is not null").join(runs.select(F.col("run_id").alias("fusion_run_id")), "fusion_run_id", "left_anti")
    if at := tables.partitions_of(orphans):
        left = upsert.set_null_missing(tables.read_partitions("fusion_pair", at), "fusion_run_id", runs, "run_id")
        tables.rewrite("pairing", {"fusion_pair": left}, at)
