"""Micro-batch queries over the jobs: ingest, scoring and pairing.

Each batch is named after its query and batch id. Tables are appended and upserted by that
name and by key, so a batch that is repeated after a failure leaves the same state.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadfuse.config import Config
from roadfuse.model.fit import score_observations
from roadfuse.operators.pairing import SENSOR_COLUMNS
from roadfuse.plans import jobs
from roadfuse.sources import uploads
from roadfuse.sources.tables import Tables
from roadfuse.streaming.intervaljoin import interval_outcomes

Clock = Callable[[], datetime.datetime]


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def _start(stream: DataFrame, name: str, checkpoint: str, trigger: dict, each: Callable) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        each(batch, f"{name}-{batch_id:012d}")

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(run).start()


def start_observation_ingest(
    text: DataFrame,
    tables: Tables,
    cfg: Config,
    checkpoint: str,
    trigger: dict | None = None,
    limited: bool = True,
    mode: str = "per_row",
) -> StreamingQuery:
    """JSON requests (``value``) -> rate limit -> validation -> new ``observation`` rows.

    Every upload ends in ``ingest_accepted`` or, with its reasons, in ``ingest_rejected``.
    """

    def each(batch: DataFrame, name: str) -> None:
        envelopes = uploads.observation_envelopes_from_text(batch)
        jobs.run_ingest_observations(envelopes, tables, cfg, name, mode, limited).checked.unpersist()

    return _start(text, "observation-ingest", checkpoint, trigger, each)


def start_frame_ingest(
    text: DataFrame,
    blobs: str,
    tables: Tables,
    cfg: Config,
    checkpoint: str,
    trigger: dict | None = None,
    limited: bool = True,
) -> StreamingQuery:
    """Frame metadata (``value``, JSON) and the folder of their blobs -> rate limit -> validation -> new ``frame`` rows."""

    def each(batch: DataFrame, name: str) -> None:
        metadata = uploads.frame_metadata_from_text(batch)
        heads = uploads.read_frame_blobs(batch.sparkSession, blobs, cfg.max_frame_size_bytes)
        jobs.run_ingest_frames(metadata, heads, tables, cfg, name, limited).checked.unpersist()

    return _start(text, "frame-ingest", checkpoint, trigger, each)


def start_rate_limit(
    requests: DataFrame, tables: Tables, cfg: Config, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Requests -> ``rate_limit_decision`` rows.

    The state is the ``device_rate_limit`` table, so a device that sends most of a batch is
    summed by many tasks instead of one keyed state.
    """

    def each(batch: DataFrame, name: str) -> None:
        tables.append("rate_limit_decision", jobs.decide(batch, tables, cfg, name), name)

    return _start(requests, "rate-limit", checkpoint, trigger, each)


def start_scoring(
    observations: DataFrame,
    tables: Tables,
    checkpoint: str,
    trigger: dict | None = None,
    clock: Clock = _now,
) -> StreamingQuery:
    """Scores arriving observations with the model active at that moment, once.

    Rows that arrive before the first model are left to ``jobs.score_new``, which takes the
    whole unscored backlog.
    """

    def each(batch: DataFrame, name: str) -> None:
        model = jobs.active_model(tables)
        if model is not None:
            scored = tables.read("observation_score", but_not=name, days=jobs.days_of(batch))
            tables.append("observation_score", score_observations(jobs.unscored(batch, scored), model, clock(), keep=("received_at",)), name)

    return _start(observations, "observation-scoring", checkpoint, trigger, each)


def start_pairing(
    frames: DataFrame,
    tables: Tables,
    cfg: Config,
    checkpoint: str,
    trigger: dict | None = None,
    clock: Clock = _now,
) -> StreamingQuery:
    """Pairs each arriving frame once with the observations stored by then.

    A frame without a candidate is marked as processed too; an observation that arrives later
    does not reopen it.
    """

    def each(batch: DataFrame, name: str) -> None:
        fresh = jobs.unprocessed(batch, tables.read("frame_processed", but_not=name, days=jobs.days_of(batch)))
        jobs.pair_new(tables, fresh, jobs.active_model(tables), cfg, clock(), name)

    return _start(frames, "frame-pairing", checkpoint, trigger, each)


def start_interval_pairing(
    frames: DataFrame,
    observations: DataFrame,
    tables: Tables,
    cfg: Config,
    checkpoint: str,
    delay: str = "10 minutes",
    trigger: dict | None = None,
    clock: Clock = _now,
) -> StreamingQuery:
    """Pairs two streams and waits up to ``delay`` for late observations before a frame is settled.

    Every frame ends in ``frame_processed`` once, with a ``fusion_pair`` or, where no observation came, without one.
    Frames that arrive behind the watermark stay open for ``jobs.run_fusion``; those it has processed meanwhile are not stored again.
    """
    outcomes = interval_outcomes(
        frames.withColumnRenamed("received_at", "frame_received_at"),
        observations.withColumnRenamed("received_at", "event_received_at"),
        cfg.fusion_window_ms,
        cfg.fusion_window_m,
        delay,
        ("frame_received_at", "device_probability"),
        ("event_received_at", *SENSOR_COLUMNS),
    )

    def each(batch: DataFrame, name: str) -> None:
        days = jobs.days_of(batch.select(F.col("frame_received_at").alias("received_at")))
        done = tables.read("frame_processed", but_not=name, days=days).select(F.col("client_id").alias("frame_client_id"))
        fresh = batch.join(done, "frame_client_id", "left_anti")
        jobs.store_outcomes(tables, fresh, jobs.active_model(tables), cfg, clock(), name)

    return _start(outcomes, "interval-pairing", checkpoint, trigger, each)


def drop_repeats(items: DataFrame, delay: str) -> DataFrame:
    """Drops repeated uploads inside the watermark, with bounded state.

    The append still checks the stored ids, which covers repeats older than ``delay``.
    """
    return items.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["client_id"])
