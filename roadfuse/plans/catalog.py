"""Every operator as a query over the supplied tables, with its SQL twin where SQL can say it.

Doubles are rounded on both sides because exp, ln and sin may differ in the last bit between
the JVM and other engines.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadfuse.functions import features, geo
from roadfuse.model import fit, forest, mixture
from roadfuse.operators import clusters, ingest, members, pairing, quality, quantile, ratelimit, readpath, reconcile, upsert, validate
from roadfuse.plans import jobs, stages
from roadfuse.plans import twins as t
from roadfuse.plans.stages import AS_OF, CFG, EARLIER_RUN, RUN_ID
from roadfuse.schema import asset_types
from roadfuse.session import cut_lineage
from roadfuse.sources import adapter, uploads

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn

    return add


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or c)


def us(c: str, name: str) -> Column:
    return F.unix_micros(c).alias(name)


# ── features, scoring ──────────────────────────────────────────────────────────


@register(
    "features_severity",
    t.twin(
        f"SELECT client_id, round({t.RATIO}, 9) AS ratio, round(coalesce(gbar_in_max, 0), 9) AS gbar,"
        f" round({t.SEVERITY}, 9) AS severity FROM observation"
    ),
)
def features_severity(spark, sf):
    ratio, gbar = features.classifier_features(F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"))
    severity = features.severity(F.col("magnitude"), F.col("speed_mps"), 5.0, 2.0)
    return adapter.observations(spark, sf).select(
        "client_id", r(ratio, 9, "ratio"), r(gbar, 9, "gbar"), r(severity, 9, "severity")
    )


@register(
    "outlier_features",
    t.twin(
        f"SELECT client_id, round({t.RATIO}, 9) AS ratio, round(coalesce(gbar_in_max, 0), 9) AS gbar,"
        " round(coalesce(magnitude, 0), 9) AS magnitude, round(coalesce(accel_std, 0), 9) AS accel_std,"
        " round(coalesce(speed_mps, 0), 9) AS speed_mps FROM observation"
    ),
)
def outlier_features(spark, sf):
    df = adapter.observations(spark, sf)
    cols = forest.outlier_inputs(df)
    return df.select("client_id", *[r(c, 9, n) for c, n in zip(cols, features.OUTLIER_FEATURES)])


@register(
    "fit_stats",
    t.twin(
        "SELECT count(*) AS n, round(avg(r), 6) AS ratio_mean, round(stddev_pop(r), 6) AS ratio_std,"
        " round(avg(g), 6) AS gbar_mean, round(stddev_pop(g), 6) AS gbar_std"
        f" FROM (SELECT {t.RATIO} AS r, coalesce(gbar_in_max, 0) AS g FROM observation"
        " WHERE magnitude IS NOT NULL AND accel_std IS NOT NULL)"
    ),
)
def fit_stats(spark, sf):
    s = mixture.feature_stats(mixture.fittable(adapter.observations(spark, sf)))
    return s.select("n", *[r(c) for c in ("ratio_mean", "ratio_std", "gbar_mean", "gbar_std")])


@register(
    "score_fixed_model",
    t.twin(
        "SELECT client_id, sensor_class, round(sensor_p_pothole, 6) AS sensor_p_pothole,"
        " round(sensor_severity, 6) AS sensor_severity, sensor_is_outlier FROM scored",
        t.SCORED,
    ),
)
def score_fixed_model(spark, sf):
    return stages.scores(spark, sf).select(
        "client_id", "sensor_class", r("sensor_p_pothole"), r("sensor_severity"), "sensor_is_outlier"
    )


@register(
    "feature_quantiles",
    t.twin(
        " UNION ALL ".join(
            f"SELECT {q}::DOUBLE AS q, round(quantile_cont(r, {q}), 9) AS ratio, round(quantile_cont(g, {q}), 9) AS gbar"
            f" FROM (SELECT {t.RATIO} AS r, coalesce(gbar_in_max, 0) AS g FROM observation"
            " WHERE magnitude IS NOT NULL AND accel_std IS NOT NULL)"
            for q in (0.05, 0.5, 0.95)
        )
    ),
)
def feature_quantiles(spark, sf):
    """The exact quantile behind the forest's threshold, over the two classifier features."""
    rows = mixture.fittable(adapter.observations(spark, sf))
    ratio, gbar = features.classifier_features(F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"))
    rows = rows.select(ratio.alias("ratio"), gbar.alias("gbar"))
    out = [(q, *[round(quantile.exact_quantile(rows, c, q), 9) for c in ("ratio", "gbar")]) for q in (0.05, 0.5, 0.95)]
    return spark.createDataFrame(out, "q double, ratio double, gbar double")


def _em_twin() -> tuple[str, list[str]]:
    """Three passes of expectation maximisation from fixed starts, written out."""
    means = [(-0.8, -0.8), (0.2, 0.2), (1.5, 1.5)]
    ctes = ["em_p AS (SELECT (r - rm) / rs AS x, (g - gm) / gs AS y FROM em_f, (SELECT avg(r) AS rm, stddev_pop(r) AS rs, avg(g) AS gm, stddev_pop(g) AS gs FROM em_f))"]
    start = " UNION ALL ".join(f"SELECT {j} AS j, 1.0::DOUBLE / 3 AS w, {a}::DOUBLE AS a, {b}::DOUBLE AS b, 1.0::DOUBLE AS xx, 0.0::DOUBLE AS xy, 1.0::DOUBLE AS yy" for j, (a, b) in enumerate(means))
    ctes.append(f"em_m0 AS ({start})")
    for i in range(3):
        ctes.append(
            f"em_d{i} AS (SELECT x, y, j, w / (2 * pi() * sqrt(xx * yy - xy * xy)) * exp(-0.5 * ((x - a) * (x - a) * yy"
            f" - 2 * (x - a) * (y - b) * xy + (y - b) * (y - b) * xx) / (xx * yy - xy * xy)) AS d, n FROM"
            f" (SELECT *, row_number() OVER () AS n FROM em_p), em_m{i})"
        )
        ctes.append(f"em_s{i} AS (SELECT x, y, j, d / sum(d) OVER (PARTITION BY n) AS s, ln(sum(d) OVER (PARTITION BY n)) AS l FROM em_d{i})")
        ctes.append(
            f"em_m{i + 1} AS (SELECT j, sum(s) / sum(sum(s)) OVER () AS w, sum(s * x) / sum(s) AS a, sum(s * y) / sum(s) AS b,"
            f" sum(s * x * x) / sum(s) - (sum(s * x) / sum(s)) ** 2 + 1e-6 AS xx, sum(s * x * y) / sum(s) - sum(s * x) * sum(s * y) / sum(s) ** 2 AS xy,"
            f" sum(s * y * y) / sum(s) - (sum(s * y) / sum(s)) ** 2 + 1e-6 AS yy, sum(l) / 1.0 AS l FROM em_s{i} GROUP BY j)"
        )
    base = f"em_f AS (SELECT {t.RATIO} AS r, coalesce(gbar_in_max, 0) AS g FROM observation WHERE magnitude IS NOT NULL AND accel_std IS NOT NULL)"
    columns = ", ".join(f"round({c}, 6) AS {c}" for c in ("w", "a", "b", "xx", "xy", "yy"))
    return f"SELECT j, {columns}, round(l / (SELECT count(*) FROM em_p), 6) AS mean_log_likelihood FROM em_m3", [base, *ctes]


_EM_SELECT, _EM_STEPS = _em_twin()


@register("gmm_em_steps", t.twin(_EM_SELECT, *_EM_STEPS))
def gmm_em_steps(spark, sf):
    """Parameters after three passes from fixed starts, and the log-likelihood per row that the third one saw."""
    rows = mixture.fittable(adapter.observations(spark, sf))
    stats = mixture.check_fittable(rows, 3)
    points = mixture.standard_points(rows, stats)
    means = np.array([[(-0.8, -0.8), (0.2, 0.2), (1.5, 1.5)]])
    now = mixture.Parameters(np.full((1, 3), 1 / 3), means, np.tile(np.eye(2), (1, 3, 1, 1)))
    for _ in range(3):
        sums = mixture.expectation(points, now)
        now = mixture.Parameters.maximised(sums)
    out = [
        (j, *[round(float(v), 6) for v in (now.weight[0, j], *now.mean[0, j], now.cov[0, j, 0, 0], now.cov[0, j, 0, 1], now.cov[0, j, 1, 1])],
         round(float(sums[0, 0, 6]) / stats.n, 6))
        for j in range(3)
    ]
    return spark.createDataFrame(out, "j int, w double, a double, b double, xx double, xy double, yy double, mean_log_likelihood double")


@register("fit_gmm")
def fit_gmm(spark, sf):
    rows = mixture.fittable(adapter.observations(spark, sf))
    stats = mixture.check_fittable(rows, CFG.fit_k)
    mix = mixture.fit_mixture(rows, stats, CFG.fit_k, CFG.random_state, CFG.fit_restarts)
    return spark.createDataFrame(
        [(c.label, c.weight, list(c.mu), [list(row) for row in c.sigma], mix.bic) for c in mix.components],
        "label string, weight double, mu array<double>, sigma array<array<double>>, bic double",
    )


@register("iforest_scores")
def iforest_scores(spark, sf):
    rows = mixture.fittable(adapter.observations(spark, sf))
    n = rows.count()
    size = min(CFG.iforest_sample, n)
    nodes = tuple(forest.grow_forest(rows, n, CFG.iforest_trees, size, CFG.random_state))
    cut = forest.outlier_threshold(rows, nodes, size, CFG.iforest_contamination)
    scored = rows.select("client_id", forest.anomaly_score(rows, nodes, size).alias("score"))
    return scored.select("client_id", "score", (-F.col("score") < cut).alias("is_outlier"))


# ── pairing and fusion ─────────────────────────────────────────────────────────


@register(
    "candidate_pairs",
    t.twin(
        "SELECT frame_client_id, event_client_id, d_us AS delta_us, round(delta_m, 6) AS delta_m"
        " FROM candidate WHERE delta_m <= 25",
        t.PAIRED,
    ),
)
def candidate_pairs(spark, sf):
    """Distinct instants and places make every observation its own spot in these tables."""
    return pairing.candidate_pairs(
        adapter.frames(spark, sf), adapter.observations(spark, sf), CFG.fusion_window_ms, CFG.fusion_window_m
    ).select("frame_client_id", "event_client_id", "delta_us", r("delta_m"))


@register(
    "pair_nearest",
    t.twin(
        "SELECT frame_client_id, event_client_id, delta_ms, round(delta_m, 6) AS delta_m FROM paired",
        *t.TO_PAIRS,
    ),
)
def pair_nearest(spark, sf):
    return stages.nearest(spark, sf).select("frame_client_id", "event_client_id", "delta_ms", r("delta_m"))


_FUSED = (
    "SELECT event_client_id, frame_client_id, round(fused_confidence, 6) AS fused_confidence,"
    " round(severity, 6) AS severity, delta_ms, round(delta_m, 6) AS delta_m FROM {}"
)


def _fused(df: DataFrame) -> DataFrame:
    return df.select(
        "event_client_id", "frame_client_id", r("fused_confidence"), r("severity"), "delta_ms", r("delta_m")
    )


@register("fuse_cold_start", t.twin(_FUSED.format("cold"), *t.TO_COLD))
def fuse_cold_start(spark, sf):
    return _fused(stages.fused(spark, sf, with_model=False))


@register("fuse_primary", t.twin(_FUSED.format("prim"), *t.TO_PRIMARY))
def fuse_primary(spark, sf):
    return _fused(stages.fused(spark, sf, with_model=True))


@register(
    "max_fused",
    t.twin(
        "SELECT event_client_id AS client_id, round(max(fused_confidence), 6) AS max_fused FROM prim GROUP BY 1",
        *t.TO_PRIMARY,
    ),
)
def max_fused(spark, sf):
    return members.best_fused(stages.fused(spark, sf, with_model=True)).select("client_id", r("max_fused"))


# ── ingest ─────────────────────────────────────────────────────────────────────

# The upload text of an observation row; some values are broken by arithmetic on the id.
_BROKEN = {
    "lat": "case when event_id % 53 = 0 then lat + 90 else lat end",
    "speed_mps": "case when event_id % 59 = 0 then -5 else speed_mps end",
    "confidence": "case when event_id % 61 = 0 then null else confidence end",
    "gbar_in_max": "case when event_id % 67 = 0 then 501 else gbar_in_max end",
    "client_id": "case when event_id % 71 = 0 then '' else client_id end",
}
_SHAPES = 6  # timestamp spellings, by event_id % 6; the last two are refused


def _ts_text() -> Column:
    at = F.timestamp_seconds(F.floor(F.col("ts_us") / 1_000_000))

    def text(pattern: str) -> Column:
        return F.date_format(at, pattern)

    kind = F.col("event_id") % _SHAPES
    return (
        F.when(kind == 0, text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 1, text("yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
        .when(kind == 2, text("yyyyMMdd'T'HHmmss'Z'"))
        .when(kind == 3, text("yyyy-MM-dd HH:mm:ss',000-00:00'"))
        .when(kind == 4, text("yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(text("yyyy-MM-dd'Z'"))
    )


def _upload_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = adapter.observations(spark, sf)
    broken = {c: F.expr(e) for c, e in _BROKEN.items()}
    return rows.withColumns(broken | {"ts": _ts_text()})


_UPLOAD = "upload AS (SELECT * REPLACE ({}), event_id % 6 < 4 AS ts_ok FROM observation)".format(
    ", ".join(f"{e} AS {c}" for c, e in _BROKEN.items())
)
_REASONS = (
    "concat_ws(',', CASE WHEN client_id = '' THEN 'client_id' END, CASE WHEN NOT ts_ok THEN 'ts' END,"
    " CASE WHEN lat > 90 THEN 'lat' END, CASE WHEN speed_mps < 0 THEN 'speed_mps' END,"
    " CASE WHEN confidence IS NULL THEN 'confidence' END, CASE WHEN gbar_in_max > 500 THEN 'gbar_in_max' END)"
)


@register(
    "validate_observations",
    t.twin(f"SELECT event_id, {_REASONS} AS reasons FROM upload", _UPLOAD),
)
def validate_observations(spark, sf):
    checked = validate.with_reasons(_upload_rows(spark, sf), validate.observation_rules(F.col))
    return checked.select("event_id", F.concat_ws(",", "reasons").alias("reasons"))


@register(
    "validate_frames",
    t.twin(
        "SELECT event_id, concat_ws(',', CASE WHEN event_id % 6 >= 4 THEN 'ts' END,"
        " CASE WHEN event_id % 43 = 0 THEN 'device_p_on_device' END) AS reasons FROM frame"
    ),
)
def validate_frames(spark, sf):
    p = F.when(F.col("event_id") % 43 == 0, F.lit(float("nan"))).otherwise(F.col("device_probability"))
    rows = adapter.frames(spark, sf).withColumns(
        {
            "ts": _ts_text(),
            "device_p_on_device": p,
            "model_id": F.lit(None).cast("string"),
            "detections": F.lit(None).cast("array<variant>"),
        }
    )
    checked = validate.with_reasons(rows, validate.frame_rules(F.col))
    return checked.select("event_id", F.concat_ws(",", "reasons").alias("reasons"))


def _as_uploads(rows: DataFrame) -> DataFrame:
    """JSON request text of observation rows, one request per row."""
    item = F.struct(
        "client_id", "schema_version", "ts", "lat", "lon", "speed_mps", "bearing_deg", "speed_accuracy_mps",
        "accel_max_g", "accel_std", "magnitude", "gbar_in_max", "confidence",
    )
    request = F.struct(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.concat(F.lit(" "), F.col("device_id")).alias("device_id"),
        F.when(F.col("event_id") % 73 == 0, F.lit("v2")).otherwise(F.lit("V1 ")).alias("accept_version"),
        "received_at",
        F.array(item).alias("events"),
    )
    return rows.select(F.to_json(request).alias("value"))


def _ingested(spark: SparkSession, sf: str) -> ingest.IngestResult:
    rows = _upload_rows(spark, sf)
    stored = adapter.observations(spark, sf).filter(F.col("received_at") < F.lit(EARLIER_RUN))
    envelopes = uploads.observation_envelopes_from_text(_as_uploads(rows))
    return ingest.ingest_observations(envelopes, stored, CFG)


@register(
    "ingest_observations",
    t.twin(
        "SELECT client_id, device_id, ts_us // 1000000 * 1000000 AS ts_us, round(lat, 9) AS lat, round(lon, 9) AS lon,"
        " round(magnitude, 9) AS magnitude, round(confidence, 9) AS confidence FROM upload"
        f" WHERE {_REASONS} = '' AND event_id % 73 <> 0 AND received_us >= {t.EARLIER_US}",
        _UPLOAD,
    ),
)
def ingest_observations(spark, sf):
    return _ingested(spark, sf).new_rows.select(
        "client_id", "device_id", us("ts_utc", "ts_us"), r("lat", 9), r("lon", 9), r("magnitude", 9), r("confidence", 9)
    )


@register(
    "ingest_outcome",
    t.twin(
        "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN event_id % 73 = 0 THEN 'accept_version'"
        f" WHEN {_REASONS} = '' THEN 'accepted' ELSE {_REASONS} END AS outcome FROM upload) GROUP BY 1",
        _UPLOAD,
    ),
)
def ingest_outcome(spark, sf):
    result = _ingested(spark, sf)
    accepted = result.accepted.select(F.lit("accepted").alias("outcome"))
    rejected = result.rejected.select(F.concat_ws(",", "reasons").alias("outcome"))
    return accepted.unionByName(rejected).groupBy("outcome").agg(F.count("*").alias("n"))


@register(
    "dedupe_observations",
    t.twin(
        "SELECT client_id, attempt, received_us FROM (SELECT *, row_number() OVER (PARTITION BY client_id"
        " ORDER BY received_us, attempt) AS rn FROM (SELECT client_id, received_us, 2 AS attempt FROM observation"
        " UNION ALL SELECT client_id, received_us - (event_id % 2) * 60000000, 1 FROM observation"
        " UNION ALL SELECT client_id, received_us + 60000000, 3 FROM observation))"
        f" WHERE rn = 1 AND client_id NOT IN (SELECT client_id FROM observation WHERE received_us < {t.EARLIER_US})"
    ),
)
def dedupe_observations(spark, sf):
    """Every observation arrives three times; what an earlier run stored is skipped."""
    rows = adapter.observations(spark, sf)
    shifts = F.array(
        F.struct(F.lit(1).alias("attempt"), (-(F.col("event_id") % 2) * 60_000_000).alias("shift")),
        F.struct(F.lit(2).alias("attempt"), F.lit(0).cast("long").alias("shift")),
        F.struct(F.lit(3).alias("attempt"), F.lit(60_000_000).cast("long").alias("shift")),
    )
    sent = rows.select("client_id", "received_us", F.inline(shifts)).select(
        "client_id", "attempt", (F.col("received_us") + F.col("shift")).alias("received_us")
    )
    stored = rows.filter(F.col("received_at") < F.lit(EARLIER_RUN))
    return ingest.append_new(sent, stored, "client_id", ["received_us", "attempt"])


_HEADS = "CASE WHEN event_id % 37 = 0 THEN 'empty' WHEN event_id % 9 >= 8 AND event_id % 5 = 0 THEN 'too_large' WHEN event_id % 41 = 0 THEN 'bad_magic' END"


@register(
    "frame_blob_checks",
    t.twin(f"SELECT coalesce({_HEADS}, 'ok') AS outcome, count(*) AS n FROM frame GROUP BY 1"),
)
def frame_blob_checks(spark, sf):
    size = F.expr(
        "case when event_id % 37 = 0 then 0 when event_id % 9 >= 8 and event_id % 5 = 0 then 10485761 else jpeg_bytes end"
    )
    head = F.when(F.col("event_id") % 41 == 0, F.unhex(F.lit("89504E"))).otherwise(F.unhex(F.lit("FFD8FF")))
    reason = F.coalesce(validate.blob_reason(size, head, CFG), F.lit("ok"))
    return adapter.frames(spark, sf).groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


@register(
    "ingest_frames",
    t.twin(
        "SELECT client_id, device_id, ts_us // 1000000 * 1000000 AS ts_us, device_id || '/' || client_id || '.jpg' AS jpeg_url,"
        " jpeg_bytes, CASE WHEN event_id % 3 > 0 THEN event_id % 3 ELSE 0 END AS detections FROM frame"
        f" WHERE event_id % 6 < 4 AND {_HEADS} IS NULL AND received_us >= {t.EARLIER_US}"
    ),
)
def ingest_frames(spark, sf):
    rows = adapter.frames(spark, sf).withColumns({"ts": _ts_text(), "path": F.concat(F.lit("/blobs/"), "client_id")})
    box = F.struct(F.lit(1).alias("class_id"), F.lit(0.5).alias("confidence"))
    request = F.struct(
        "client_id", "device_id", "received_at", "path", "ts", "lat", "lon",
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id"),
        F.lit("v1").alias("accept_version"),
        F.col("device_probability").alias("device_p_on_device"),
        F.array_repeat(box, (F.col("event_id") % 3).cast("int")).alias("detections"),
    )
    metadata = uploads.frame_metadata_from_text(rows.select(F.to_json(request).alias("value")))
    blobs = rows.select(
        "path",
        F.expr(
            "case when event_id % 37 = 0 then 0 when event_id % 9 >= 8 and event_id % 5 = 0 then 10485761 else jpeg_bytes end"
        ).alias("length"),
        F.when(F.col("event_id") % 41 == 0, F.unhex(F.lit("89504E"))).otherwise(F.unhex(F.lit("FFD8FF"))).alias("head"),
    )
    stored = adapter.frames(spark, sf).filter(F.col("received_at") < F.lit(EARLIER_RUN))
    new = ingest.ingest_frames(metadata, blobs, stored, CFG).new_rows
    found = F.coalesce(F.size(F.from_json("device_detections", "array<string>")), F.lit(0))
    return new.select(
        "client_id", "device_id", us("ts_utc", "ts_us"), "jpeg_url", "jpeg_bytes", found.cast("long").alias("detections")
    )


_REQUEST_SQL = (
    "request AS (SELECT client_id AS request_id, device_id, 'events' AS resource, ts_us, 1 AS n FROM observation"
    " UNION ALL SELECT client_id, device_id, 'frames', ts_us, 1 FROM frame),"
    " bucket AS (SELECT device_id, resource, ts_us // 60000000 * 60 AS b, sum(n) AS n FROM request GROUP BY 1, 2, 3),"
    " before AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY device_id, resource ORDER BY b RANGE BETWEEN 3540 PRECEDING AND 60 PRECEDING), 0) AS inside,"
    " coalesce(sum(n) OVER (PARTITION BY device_id, resource ORDER BY b RANGE BETWEEN 3600 PRECEDING AND 60 PRECEDING), 0) AS edge FROM bucket)"
)
_LIMIT_SQL = (
    "SELECT request_id, resource, cast(current AS bigint) AS current, current <= 100 AS allowed FROM ("
    "SELECT q.request_id, q.resource, sum(q.n) OVER (PARTITION BY q.device_id, q.resource, w.b ORDER BY q.ts_us, md5(q.request_id), q.request_id"
    " ROWS UNBOUNDED PRECEDING) + CASE WHEN q.ts_us % 60000000 = 0 THEN w.edge ELSE w.inside END AS current"
    " FROM request q JOIN before w ON w.device_id = q.device_id AND w.resource = q.resource AND w.b = q.ts_us // 60000000 * 60)"
)


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event and frame as one upload request, at its ``ts_utc``."""

    def of(df: DataFrame, resource: str) -> DataFrame:
        return df.select(
            F.col("client_id").alias("request_id"),
            "device_id",
            F.lit(resource).alias("resource"),
            F.col("ts_utc").alias("received_at"),
            F.lit(1).cast("long").alias("n"),
        )

    return of(adapter.observations(spark, sf), "events").unionByName(of(adapter.frames(spark, sf), "frames"))


@register("rate_limit_hourly", t.twin(_LIMIT_SQL, _REQUEST_SQL))
def rate_limit_hourly(spark, sf):
    return ratelimit.check_rate_limit(requests(spark, sf), {"events": 100, "frames": 100}).select(
        "request_id", "resource", "current", "allowed"
    )


@register("rate_limit_hourly_sliced", t.twin(_LIMIT_SQL, _REQUEST_SQL))
def rate_limit_hourly_sliced(spark, sf):
    """The limit again, per request and without the columns of the request."""
    return ratelimit.check_rate_limit(
        requests(spark, sf), {"events": 100, "frames": 100}
    ).select("request_id", "resource", "current", "allowed")


@register(
    "rate_limit_buckets",
    t.twin(
        "SELECT device_id, resource, b * 1000000 AS window_start_us, cast(n AS bigint) AS request_count FROM bucket",
        _REQUEST_SQL,
    ),
)
def rate_limit_buckets(spark, sf):
    return ratelimit.bucket_counts(requests(spark, sf)).select(
        "device_id", "resource", us("window_start", "window_start_us"), "request_count"
    )


# ── work queues ────────────────────────────────────────────────────────────────


@register(
    "top_unscored",
    t.twin(
        "SELECT client_id, received_us FROM observation WHERE client_id NOT IN"
        f" (SELECT client_id FROM observation WHERE received_us < {t.EARLIER_US})"
        " ORDER BY received_us, client_id LIMIT 500"
    ),
)
def top_unscored(spark, sf):
    rows = adapter.observations(spark, sf)
    scored = rows.filter(F.col("received_at") < F.lit(EARLIER_RUN))
    return jobs.unscored(rows, scored, 500).select("client_id", "received_us")


@register(
    "top_unprocessed_frames",
    t.twin(
        "SELECT client_id, received_us FROM frame WHERE client_id NOT IN"
        f" (SELECT client_id FROM frame WHERE received_us < {t.EARLIER_US})"
        " ORDER BY received_us, client_id LIMIT 500"
    ),
)
def top_unprocessed_frames(spark, sf):
    rows = adapter.frames(spark, sf)
    return jobs.unprocessed(rows, rows.filter(F.col("received_at") < F.lit(EARLIER_RUN)), 500).select(
        "client_id", "received_us"
    )


@register(
    "latest_observations",
    t.twin("SELECT client_id, device_id, received_us FROM observation ORDER BY received_us DESC, client_id LIMIT 5"),
)
def latest_observations(spark, sf):
    return (
        adapter.observations(spark, sf)
        .orderBy(F.desc("received_us"), "client_id")
        .limit(5)
        .select("client_id", "device_id", "received_us")
    )


# ── clustering ─────────────────────────────────────────────────────────────────


@register(
    "cluster_members",
    t.twin(
        "SELECT client_id, device_id, ts_us, round(severity, 6) AS severity, round(confidence, 6) AS confidence FROM member",
        *t.TO_MEMBERS,
    ),
)
def cluster_members(spark, sf):
    return stages.chosen_members(spark, sf).select(
        "client_id", "device_id", us("ts_utc", "ts_us"), r("severity"), r("confidence")
    )


@register(
    "suppress_repaired",
    t.twin(
        "SELECT client_id FROM observation o WHERE NOT EXISTS (SELECT 1 FROM site_cluster c WHERE c.repaired_us >= o.ts_us"
        f" AND {t.distance_sql('c.lat', 'c.lon', 'o.lat', 'o.lon')} <= 25)",
        t.SITES,
    ),
)
def suppress_repaired(spark, sf):
    rows = adapter.observations(spark, sf).select("client_id", "lat", "lon", "ts_utc")
    return members.suppress_repaired(rows, stages.site_clusters(spark, sf), CFG.cluster_eps_m).select("client_id")


@register(
    "member_stats",
    t.twin(
        "SELECT n, round(mean_lat, 9) AS mean_lat, round(25 / greatest(cos(radians(mean_lat)), 1e-6), 6) AS eps_units"
        " FROM (SELECT count(*) AS n, avg(lat) AS mean_lat FROM member)",
        *t.TO_MEMBERS,
    ),
)
def member_stats(spark, sf):
    eps = CFG.cluster_eps_m / F.greatest(F.cos(F.radians("mean_lat")), F.lit(1e-6))
    return members.member_stats(stages.chosen_members(spark, sf)).select("n", r("mean_lat", 9), r(eps, 6, "eps_units"))


@register("dbscan_labels", t.twin("SELECT client_id, label FROM labelled", *t.TO_LABELS))
def dbscan_labels(spark, sf):
    return stages.labelled_members(spark, sf).select("client_id", "label")


@register(
    "cluster_aggregate",
    t.twin(
        "SELECT label, round(lat, 6) AS lat, round(lon, 6) AS lon, round(severity, 6) AS severity,"
        " round(confidence, 6) AS confidence, observation_count, distinct_devices, last_seen_us FROM fresh",
        *t.TO_FRESH,
    ),
)
def cluster_aggregate(spark, sf):
    return clusters.aggregate_clusters(stages.labelled_members(spark, sf)).select(
        "label", r("lat"), r("lon"), r("severity"), r("confidence"), "observation_count", "distinct_devices",
        us("last_seen", "last_seen_us"),
    )


@register(
    "cluster_median_ranked",
    t.twin(
        "SELECT device_id, round(quantile_cont(severity, 0.5), 9) AS median FROM"
        f" (SELECT device_id, {t.SEVERITY} AS severity FROM observation) GROUP BY device_id"
    ),
)
def cluster_median_ranked(spark, sf):
    """Median per group, here of devices with very many values."""
    severity = features.severity(F.col("magnitude"), F.col("speed_mps"), 5.0, 2.0)
    rows = adapter.observations(spark, sf).select("device_id", severity.alias("severity"))
    return clusters.group_median(rows, "device_id", "severity").select("device_id", r("median", 9))


@register(
    "cluster_member_rows",
    t.twin(
        "SELECT label, client_id AS member_id, round(confidence, 6) AS fused_confidence FROM labelled", *t.TO_LABELS
    ),
)
def cluster_member_rows(spark, sf):
    return clusters.member_rows(stages.labelled_members(spark, sf)).select("label", "member_id", r("fused_confidence"))


_MATCH = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY label) AS i FROM fresh),
possible AS (
  SELECT f.i, c.cluster_id, {t.distance_sql('c.lat', 'c.lon', 'f.lat', 'f.lon')} AS d
  FROM numbered f JOIN site_cluster c ON c.repaired_us IS NULL
   AND {t.distance_sql('c.lat', 'c.lon', 'f.lat', 'f.lon')} <= 25),
walk(i, pick, claimed) AS (
  SELECT 0, cast(NULL AS varchar), cast([] AS varchar[])
  UNION ALL
  SELECT i + 1, pick, CASE WHEN pick IS NULL THEN claimed ELSE list_append(claimed, pick) END FROM (
    SELECT w.i, w.claimed, (SELECT arg_min(p.cluster_id, (p.d, p.cluster_id)) FROM possible p
      WHERE p.i = w.i + 1 AND NOT list_contains(w.claimed, p.cluster_id)) AS pick
    FROM walk w WHERE w.i < (SELECT count(*) FROM numbered))),
mapped AS (
  SELECT n.label, coalesce(w.pick, 'clu_' || md5('{RUN_ID}|' || n.label)) AS cluster_id, w.pick IS NULL AS is_new
  FROM numbered n JOIN walk w ON w.i = n.i)"""


def _mapping(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    labelled = stages.labelled_members(spark, sf)
    fresh = cut_lineage(clusters.aggregate_clusters(labelled))
    return labelled, fresh, reconcile.reconcile(fresh, stages.site_clusters(spark, sf), CFG.cluster_eps_m, RUN_ID)


@register("reconcile_clusters", t.twin("SELECT label, cluster_id, is_new FROM mapped", *t.TO_FRESH, _MATCH))
def reconcile_clusters(spark, sf):
    return _mapping(spark, sf)[2]


_UPSERTED_SQL = f"""
SELECT coalesce(n.cluster_id, c.cluster_id) AS cluster_id,
  round(CASE WHEN n.cluster_id IS NULL THEN c.severity ELSE n.severity END, 6) AS severity,
  CASE WHEN n.cluster_id IS NULL THEN c.observation_count ELSE n.observation_count END AS observation_count,
  coalesce(c.source, 'crowd') AS source, coalesce(c.repaired_us, 0) AS repaired_us,
  CASE WHEN c.cluster_id IS NULL THEN {t.AS_OF_US} ELSE {t.EARLIER_US} END AS created_us,
  CASE WHEN n.cluster_id IS NULL THEN {t.EARLIER_US} ELSE {t.AS_OF_US} END AS updated_us
FROM site_cluster c FULL JOIN (SELECT m.cluster_id, f.* FROM mapped m JOIN fresh f ON f.label = m.label) n
  ON n.cluster_id = c.cluster_id"""


@register("upsert_clusters", t.twin(_UPSERTED_SQL, *t.TO_FRESH, _MATCH))
def upsert_clusters(spark, sf):
    _, fresh, mapping = _mapping(spark, sf)
    kept = ["asset_type", "source", "repaired_at", "created_at"]
    rows = jobs.cluster_rows(fresh, mapping, AS_OF)
    return upsert.upsert(stages.site_clusters(spark, sf), rows, ["cluster_id"], kept).select(
        "cluster_id", r("severity"), "observation_count", "source",
        F.coalesce(F.unix_micros("repaired_at"), F.lit(0)).alias("repaired_us"),
        us("created_at", "created_us"), us("updated_at", "updated_us"),
    )


def _early_pairs(spark: SparkSession, sf: str) -> DataFrame:
    early = adapter.frames(spark, sf).filter(F.col("received_at") < F.lit(EARLIER_RUN))
    pairs = stages.fused(spark, sf, with_model=False).join(
        early.select(F.col("client_id").alias("frame_client_id")), "frame_client_id", "left_semi"
    )
    return pairs.withColumns({"fusion_run_id": F.lit("run-1"), "created_at": F.lit(EARLIER_RUN).cast("timestamp")})


@register(
    "upsert_pairs",
    t.twin(
        "SELECT p.event_client_id, p.frame_client_id, round(p.fused_confidence, 6) AS fused_confidence,"
        f" '{RUN_ID}' AS fusion_run_id, CASE WHEN f.received_us < {t.EARLIER_US} THEN {t.EARLIER_US} ELSE {t.AS_OF_US} END AS created_us"
        " FROM prim p JOIN frame f ON f.client_id = p.frame_client_id",
        *t.TO_PRIMARY,
    ),
)
def upsert_pairs(spark, sf):
    """A later run with a model overwrites the pairs of an earlier cold-start run."""
    later = stages.fused(spark, sf, with_model=True).withColumns(
        {"fusion_run_id": F.lit(RUN_ID), "created_at": F.lit(AS_OF).cast("timestamp")}
    )
    merged = upsert.upsert(
        _early_pairs(spark, sf), later, ["event_client_id", "frame_client_id"], ["created_at"]
    )
    return merged.select(
        "event_client_id", "frame_client_id", r("fused_confidence"), "fusion_run_id", us("created_at", "created_us")
    )


@register(
    "link_rebuild",
    t.twin(
        "SELECT cluster_id, member_id, kind, round(fused_confidence, 6) AS fused_confidence FROM site_link"
        " WHERE cluster_id NOT IN (SELECT cluster_id FROM mapped) UNION ALL"
        " SELECT m.cluster_id, l.client_id, 'observation', round(l.confidence, 6) FROM labelled l JOIN mapped m ON m.label = l.label",
        *t.TO_FRESH, _MATCH, t.SITE_LINKS,
    ),
)
def link_rebuild(spark, sf):
    labelled, _, mapping = _mapping(spark, sf)
    new = clusters.member_rows(labelled).join(mapping, "label").select(
        "cluster_id", "member_id", F.lit("observation").alias("kind"), "fused_confidence"
    )
    return upsert.rebuild_links(stages.site_links(spark, sf), new).select(
        "cluster_id", "member_id", "kind", r("fused_confidence")
    )


@register(
    "cluster_asset_names",
    t.twin("SELECT cluster_id, asset_type, 'Pothole' AS display_name FROM site_cluster", t.SITES),
)
def cluster_asset_names(spark, sf):
    names = asset_types(spark).select("asset_type", "display_name")
    return stages.site_clusters(spark, sf).join(names, "asset_type", "left").select(
        "cluster_id", "asset_type", "display_name"
    )


# ── quality, read side, retention ──────────────────────────────────────────────


@register(
    "quality_checks",
    t.twin(
        "SELECT 'observations_unpaired' AS check_name, count(*) AS violations FROM observation WHERE client_id NOT IN (SELECT event_client_id FROM cold)"
        " UNION ALL SELECT 'frames_unpaired', count(*) FROM frame WHERE client_id NOT IN (SELECT frame_client_id FROM cold)"
        " UNION ALL SELECT 'pairs_late', count(*) FROM cold WHERE abs(delta_ms) > 2500"
        " UNION ALL SELECT 'clusters_single_device', count(*) FROM site_cluster WHERE distinct_devices = 1",
        *t.TO_COLD, t.SITES,
    ),
)
def quality_checks(spark, sf):
    return quality.counted(
        quality.pairing_quality(
            adapter.observations(spark, sf),
            adapter.frames(spark, sf),
            stages.fused(spark, sf, with_model=False),
            stages.site_clusters(spark, sf),
        )
    )


@register(
    "integrity_checks",
    t.twin(
        "SELECT 'observation_key' AS check_name, count(*) AS violations FROM (SELECT client_id FROM observation GROUP BY 1 HAVING count(*) > 1)"
        " UNION ALL SELECT 'observation_required', count(*) FROM observation WHERE lat IS NULL OR confidence IS NULL"
        " UNION ALL SELECT 'frame_key', count(*) FROM (SELECT client_id FROM frame GROUP BY 1 HAVING count(*) > 1)"
        " UNION ALL SELECT 'frame_required', count(*) FROM frame WHERE lat IS NULL"
        " UNION ALL SELECT 'pair_key', 0 UNION ALL SELECT 'pair_observation', 0"
        f" UNION ALL SELECT 'pair_frame', count(*) FROM cold WHERE frame_client_id NOT IN (SELECT client_id FROM frame WHERE received_us < {t.EARLIER_US})"
        " UNION ALL SELECT 'cluster_key', 0 UNION ALL SELECT 'cluster_source', 0 UNION ALL SELECT 'link_key', 0 UNION ALL SELECT 'link_kind', 0"
        " UNION ALL SELECT 'link_cluster', count(*) FROM site_link WHERE cluster_id NOT IN (SELECT cluster_id FROM site_cluster WHERE repaired_us IS NULL)",
        *t.TO_COLD, t.SITES, t.SITE_LINKS,
    ),
)
def integrity_checks(spark, sf):
    """Key, null, enumeration and reference checks; late frames and repaired clusters are withheld."""
    site = stages.site_clusters(spark, sf)
    frames = adapter.frames(spark, sf)
    tables = {
        "observation": adapter.observations(spark, sf),
        "frame": frames,
        "fusion_pair": stages.fused(spark, sf, with_model=False),
        "cluster": site,
        "cluster_link": stages.site_links(spark, sf),
    }
    checks = quality.integrity_checks(tables)
    early = frames.filter(F.col("received_at") < F.lit(EARLIER_RUN))
    checks["pair_frame"] = quality.orphans(tables["fusion_pair"], "frame_client_id", early, "client_id")
    checks["link_cluster"] = quality.orphans(
        tables["cluster_link"], "cluster_id", site.filter(F.col("repaired_at").isNull()), "cluster_id"
    )
    return quality.counted(checks)


@register(
    "ingest_rate_anomalies",
    t.twin(
        "SELECT cast(epoch_us(hour) AS bigint) AS hour_us, n FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events"
        " WHERE event_type <> 'purchase' GROUP BY 1), (SELECT avg(n) AS mean, stddev_pop(n) AS dev FROM (SELECT count(*) AS n FROM events"
        " WHERE event_type <> 'purchase' GROUP BY date_trunc('hour', ts))) WHERE abs(n - mean) > 2 * dev"
    ),
)
def ingest_rate_anomalies(spark, sf):
    return quality.ingest_rate_anomalies(adapter.observations(spark, sf), 2.0).select(us("hour", "hour_us"), "n")


@register(
    "model_disagreement",
    t.twin(
        "SELECT client_id, round(device_probability, 6) AS device_probability, round(fused_confidence, 6) AS server_probability"
        " FROM cold JOIN frame ON client_id = frame_client_id WHERE abs(device_probability - fused_confidence) > 0.3",
        *t.TO_COLD,
    ),
)
def model_disagreement(spark, sf):
    """The fused confidence stands in for a server-side probability."""
    server = stages.fused(spark, sf, with_model=False).select(
        F.col("frame_client_id").alias("client_id"), F.col("fused_confidence").alias("server_probability")
    )
    both = adapter.frames(spark, sf).join(server, "client_id")
    return quality.model_disagreement(both, "device_probability", "server_probability").select(
        "client_id", r("device_probability"), r("server_probability")
    )


@register(
    "compare_runs",
    t.twin(
        f"SELECT count(*) FILTER (a IS NOT NULL) AS common, cast(0 AS bigint) AS only_before, count(*) FILTER (a IS NULL) AS only_after,"
        " count(*) FILTER ((a >= 0.5) <> (b >= 0.5)) AS flipped, round(avg(abs(a - b)), 6) AS mean_change FROM ("
        f" SELECT CASE WHEN f.received_us < {t.EARLIER_US} THEN c.fused_confidence END AS a, p.fused_confidence AS b"
        " FROM prim p JOIN cold c ON c.frame_client_id = p.frame_client_id JOIN frame f ON f.client_id = p.frame_client_id)",
        t.SCORED, t.PAIRED, t.COLD, t.PRIMARY,
    ),
)
def compare_runs(spark, sf):
    return quality.compare_runs(_early_pairs(spark, sf), stages.fused(spark, sf, with_model=True)).withColumn(
        "mean_change", F.round("mean_change", 6)
    )


@register(
    "public_clusters",
    t.twin("SELECT cluster_id, distinct_devices FROM site_cluster WHERE repaired_us IS NULL AND distinct_devices >= 2", t.SITES),
)
def public_clusters(spark, sf):
    return readpath.public_clusters(stages.site_clusters(spark, sf), CFG).select("cluster_id", "distinct_devices")


_BOX = (43.65, -79.35, 44.1, -78.9)


@register(
    "map_items",
    t.twin(
        "SELECT cluster_id, 'pothole' AS type, round(lat, 6) AS lat, round(lon, 6) AS lon, observation_count AS event_count"
        " FROM site_cluster WHERE repaired_us IS NULL AND lat BETWEEN 43.65 AND 44.1 AND lon BETWEEN -79.35 AND -78.9",
        t.SITES,
    ),
)
def map_items(spark, sf):
    return readpath.map_window(stages.site_clusters(spark, sf), *_BOX, zoom=15).select(
        "cluster_id", "type", r("lat"), r("lon"), "event_count"
    )


def _tile_sql(z: int) -> str:
    n = 1 << z
    y = f"(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * {n}"
    return f"cast(floor((lon + 180) / 360 * {n}) AS bigint) AS x, cast(floor({y}) AS bigint) AS y"


@register(
    "map_aggregates",
    t.twin(
        "SELECT 'cluster' AS type, round(avg(lat), 6) AS centroid_lat, round(avg(lon), 6) AS centroid_lon, count(*) AS count,"
        f" round(max(severity), 6) AS max_severity FROM (SELECT *, {_tile_sql(14)} FROM site_cluster"
        " WHERE repaired_us IS NULL AND lat BETWEEN 43.65 AND 44.1 AND lon BETWEEN -79.35 AND -78.9) GROUP BY x, y",
        t.SITES,
    ),
)
def map_aggregates(spark, sf):
    return readpath.map_window(stages.site_clusters(spark, sf), *_BOX, zoom=10).select(
        "type", r("centroid_lat"), r("centroid_lon"), "count", r("max_severity")
    )


@register(
    "zoom_tiles",
    t.twin(
        "SELECT 'pothole' AS asset_type, z, x, y, count(*) AS clusters, cast(sum(observation_count) AS bigint) AS observations,"
        " round(max(severity), 6) AS max_severity FROM ("
        + " UNION ALL ".join(
            f"SELECT {z} AS z, {_tile_sql(z)}, observation_count, severity FROM fresh" for z in readpath.TILE_ZOOMS
        )
        + ") GROUP BY z, x, y",
        *t.TO_FRESH,
    ),
)
def zoom_tiles(spark, sf):
    fresh = clusters.aggregate_clusters(stages.labelled_members(spark, sf)).withColumns(
        {"asset_type": F.lit("pothole"), "repaired_at": F.lit(None).cast("timestamp")}
    )
    return readpath.zoom_tiles(fresh).select(
        "asset_type", "z", "x", "y", "clusters", "observations", r("max_severity")
    )


_BUDGET = 200_000_000
_LATE = datetime.datetime(2024, 4, 5, tzinfo=datetime.timezone.utc)


@register(
    "frame_retention",
    t.twin(
        "SELECT client_id, aged, total > 200000000 AS over_budget FROM (SELECT client_id,"
        f" received_us < {t._us(_LATE)} - 90 * 86400000000 AS aged,"
        " sum(jpeg_bytes) OVER (PARTITION BY device_id ORDER BY received_us DESC, md5(client_id), client_id ROWS UNBOUNDED PRECEDING) AS total"
        " FROM frame) WHERE aged OR total > 200000000"
    ),
)
def frame_retention(spark, sf):
    return readpath.frames_to_delete(adapter.frames(spark, sf), _LATE, _BUDGET).select(
        "client_id", "aged", "over_budget"
    )


@register(
    "tight_clusters",
    t.twin(
        "SELECT cluster_id, members, round(h, 6) AS height_m, round(wd, 6) AS width_m FROM (SELECT cluster_id, members,"
        f" {t.distance_sql('s', 'w', 'n', 'w')} AS h, {t.distance_sql('(s + n) / 2', 'w', '(s + n) / 2', 'e')} AS wd FROM ("
        " SELECT cluster_id, count(*) AS members, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e"
        " FROM site_link JOIN observation ON client_id = member_id GROUP BY 1)) WHERE h <= 30 AND wd <= 30",
        t.SITE_LINKS,
    ),
)
def tight_clusters(spark, sf):
    return readpath.tight_clusters(stages.site_links(spark, sf), adapter.observations(spark, sf), 30.0).select(
        "cluster_id", "members", r("height_m"), r("width_m")
    )


@register(
    "delete_device",
    t.twin(
        "SELECT p.event_client_id, p.frame_client_id FROM cold p WHERE p.event_client_id NOT IN (SELECT client_id FROM observation WHERE device_id = 'dev-7')"
        " AND p.frame_client_id NOT IN (SELECT client_id FROM frame WHERE device_id = 'dev-7')",
        *t.TO_COLD,
    ),
)
def delete_device(spark, sf):
    """Pairs that stay when a device and all its rows are removed."""
    gone_obs = adapter.observations(spark, sf).filter("device_id = 'dev-7'")
    gone_frames = adapter.frames(spark, sf).filter("device_id = 'dev-7'")
    pairs = stages.fused(spark, sf, with_model=False)
    pairs = upsert.delete_cascade(gone_obs, "client_id", pairs, "event_client_id")
    return upsert.delete_cascade(gone_frames, "client_id", pairs, "frame_client_id").select(
        "event_client_id", "frame_client_id"
    )


@register(
    "grid_cells",
    t.twin("SELECT count(*) AS n FROM observation"),
)
def grid_cells(spark, sf):
    """Every point lies in a cell its own search box covers."""
    rows = adapter.observations(spark, sf).select("client_id", "lat", "lon")
    cells = geo.explode_cells(rows, "lat", "lon", 25.0, "cell")
    own = cells.filter(F.col("cell") == geo.grid_cell(F.col("lat"), F.col("lon"), 25.0))
    return own.agg(F.count("*").alias("n"))
