"""Late fusion of the sensor and camera signals in logit space.

A strategy turns the columns of a pair into ``struct<fused_confidence, severity>``. New ones
are added with :func:`register_strategy`; a strategy may also wrap a ``pandas_udf``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadfuse.config import FALLBACK_ENGINE, PRIMARY_ENGINE, Config
from roadfuse.functions import features

LOGIT_EPS = 1e-6  # fixed value


def sigmoid(x: Column) -> Column:
    z = F.exp(-F.abs(x))
    return F.when(x >= 0.0, 1.0 / (1.0 + z)).otherwise(z / (1.0 + z))


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def logit(p: Column) -> Column:
    q = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(LOGIT_EPS)), F.lit(1.0 - LOGIT_EPS)))
    return F.log(q / (1.0 - q))


def weighted_logit(p: Column, weight: float) -> Column:
    """``weight * logit(p)``; a missing probability adds nothing."""
    return F.coalesce(weight * logit(clamp01(p)), F.lit(0.0))


@dataclass(frozen=True)
class PairColumns:
    """Inputs of one candidate pair."""

    magnitude: Column
    accel_std: Column
    gbar_in_max: Column
    speed_mps: Column
    sensor_p_pothole: Column
    sensor_severity: Column
    visual_confidence: Column
    delta_ms: Column
    delta_m: Column

    @classmethod
    def named(cls) -> PairColumns:
        return cls(**{name: F.col(name) for name in cls.__dataclass_fields__})


@dataclass(frozen=True)
class FusionStrategy:
    version: str
    weights: dict[str, float]
    fuse: Callable[[PairColumns], Column]


def _output(confidence: Column, severity: Column) -> Column:
    return F.struct(confidence.alias("fused_confidence"), severity.alias("severity"))


def primary(cfg: Config) -> FusionStrategy:
    """Scored sensor probability and visual confidence; severity is handed through."""

    def fuse(p: PairColumns) -> Column:
        total = weighted_logit(p.sensor_p_pothole, cfg.fusion_w_s) + weighted_logit(
            p.visual_confidence, cfg.fusion_w_v
        )
        return _output(sigmoid(total), F.coalesce(p.sensor_severity, F.lit(0.0)))

    return FusionStrategy(PRIMARY_ENGINE, {"w_s": cfg.fusion_w_s, "w_v": cfg.fusion_w_v}, fuse)


def cold_start(cfg: Config) -> FusionStrategy:
    """No model yet: the sensor probability comes from the standardised ratio."""
    spread = cfg.fallback_ratio_std if cfg.fallback_ratio_std > 0 else 1.0

    def fuse(p: PairColumns) -> Column:
        ratio = features.ratio(p.magnitude, p.accel_std)
        sensor = sigmoid((ratio - cfg.fallback_ratio_mean) / spread)
        total = weighted_logit(sensor, cfg.fusion_w_s) + weighted_logit(
            p.visual_confidence, cfg.fusion_w_v
        )
        severity = features.severity(
            p.magnitude, p.speed_mps, cfg.severity_speed_ref, cfg.severity_scale
        )
        return _output(sigmoid(total), severity)

    weights = {
        "w_s": cfg.fusion_w_s,
        "w_v": cfg.fusion_w_v,
        "ratio_mean": cfg.fallback_ratio_mean,
        "ratio_std": spread,
    }
    return FusionStrategy(FALLBACK_ENGINE, weights, fuse)


_STRATEGIES: dict[str, Callable[[Config], FusionStrategy]] = {
    PRIMARY_ENGINE: primary,
    FALLBACK_ENGINE: cold_start,
}


def register_strategy(version: str, build: Callable[[Config], FusionStrategy]) -> None:
    _STRATEGIES[version] = build


def select_strategy(cfg: Config, has_model: bool) -> FusionStrategy:
    """The configured strategy once a model is active, the cold-start one otherwise."""
    if has_model and cfg.fusion_engine_version in _STRATEGIES:
        return _STRATEGIES[cfg.fusion_engine_version](cfg)
    return cold_start(cfg)
