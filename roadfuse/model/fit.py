"""The fit job: gate, mixture, forest, artifact."""

from __future__ import annotations

import logging
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.config import Config
from roadfuse.functions.posterior import score_columns
from roadfuse.model import forest, mixture
from roadfuse.model.artifact import SensorModel

log = logging.getLogger(__name__)


def gate_open(total: int, active: SensorModel | None, minimum: int) -> bool:
    """Enough rows, and enough new rows since the active model."""
    return total >= minimum and (active is None or total - active.n_observations >= minimum)


def fit_model(rows: DataFrame, cfg: Config) -> SensorModel:
    """Fits on all fittable rows; raises :class:`mixture.FitError` on hopeless data."""
    stats = mixture.check_fittable(rows, cfg.fit_k)
    mix = mixture.fit_mixture(rows, stats, cfg.fit_k, cfg.random_state, cfg.fit_restarts)
    size = min(cfg.iforest_sample, stats.n)
    nodes = tuple(forest.grow_forest(rows, stats.n, cfg.iforest_trees, size, cfg.random_state))
    return SensorModel(
        version=f"mixture-{uuid4()}",
        centre=stats.centre,
        spread=stats.spread,
        components=mix.components,
        pace_floor=cfg.severity_speed_ref,
        impact_scale=cfg.severity_scale,
        k=cfg.fit_k,
        n_observations=stats.n,
        bic=mix.bic,
        forest=nodes,
        forest_sample=size,
        outlier_threshold=forest.outlier_threshold(rows, nodes, size, cfg.iforest_contamination),
    )


def fit_sensor_model(observations: DataFrame, active: SensorModel | None, cfg: Config) -> SensorModel | None:
    """A new model, or None while the gate is shut or the data cannot be fitted."""
    rows = mixture.fittable(observations)
    if not gate_open(rows.count(), active, cfg.fit_min_observations):
        return None
    try:
        return fit_model(rows, cfg)
    except mixture.FitError as e:
        log.warning("sensor model fit failed: %s", e)
        return None


def score_observations(observations: DataFrame, model: SensorModel, scored_at, keep: tuple[str, ...] = ()) -> DataFrame:
    """Observations -> ``observation_score`` rows (one projection, no shuffle); ``keep`` columns stay."""
    scored = score_columns(observations, model)
    outlier = F.col("_degenerate")
    if model.forest:
        score = forest.anomaly_score(scored, model.forest, model.forest_sample)
        scored = scored.withColumn("_score", score)
        outlier = outlier | (-F.col("_score") < model.outlier_threshold)
    return scored.select(
        "client_id",
        "sensor_class",
        "sensor_p_pothole",
        "sensor_severity",
        outlier.alias("sensor_is_outlier"),
        F.lit(model.version).alias("sensor_model_version"),
        F.lit(scored_at).cast("timestamp").alias("scored_at"),
        *keep,
    )
