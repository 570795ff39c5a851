"""Scoring columns of a fitted sensor model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.config import CLASS_NOT, CLASS_POTHOLE
from roadfuse.functions import features
from roadfuse.model.artifact import Component, SensorModel


def z_score(x: Column, mean: float, std: float) -> Column:
    return (x - float(mean)) / (float(std) if std > 0 else 1.0)


def density(component: Component, z0: Column, z1: Column) -> Column:
    """Weighted 2-D normal density. It may underflow to 0, which marks a degenerate point.

    A stored covariance without an inverse gives 0 everywhere.
    """
    (a, b), (c, d) = component.sigma
    det = a * d - b * c
    if not det > 0:
        return z0 * 0.0
    dx, dy = z0 - component.mu[0], z1 - component.mu[1]
    q = (dx * dx * d - dx * dy * (b + c) + dy * dy * a) / det
    return F.exp(q * -0.5) * (component.weight / (2.0 * math.pi * math.sqrt(det)))


def score_columns(df: DataFrame, model: SensorModel) -> DataFrame:
    """Adds ``sensor_class``, ``sensor_p_pothole``, ``sensor_severity`` and ``_degenerate``.

    Everything is column arithmetic over model literals: one projection, no join. Ties go to
    the class that comes first in component order.
    """
    ratio, gbar = features.classifier_features(F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"))
    out = df.withColumns(
        {f"_z{i}": z_score(x, m, s) for i, (x, m, s) in enumerate(zip((ratio, gbar), model.centre, model.spread))}
    )
    out = out.withColumns(
        {f"_d{i}": density(c, F.col("_z0"), F.col("_z1")) for i, c in enumerate(model.components)}
    )
    total = sum((F.col(f"_d{i}") for i in range(1, len(model.components))), F.col("_d0"))
    out = out.withColumn("_total", total)
    usable = (F.col("_total") > 0.0) & (F.col("_total") < float("inf")) & ~F.isnan("_total")
    out = out.withColumn("_degenerate", ~F.coalesce(usable, F.lit(False)))

    by_class: dict[str, Column] = {}
    for i, c in enumerate(model.components):
        share = F.when(~F.col("_degenerate"), F.col(f"_d{i}") / F.col("_total"))
        by_class[c.label] = by_class[c.label] + share if c.label in by_class else share
    names = {label: f"_p_{label}" for label in by_class}
    out = out.withColumns({names[label]: p for label, p in by_class.items()})
    best = F.greatest(*[F.col(n) for n in names.values()], F.lit(-1.0))
    winner = F.coalesce(*[F.when(F.col(n) == best, F.lit(label)) for label, n in names.items()])
    pothole = F.col(names[CLASS_POTHOLE]) if CLASS_POTHOLE in names else F.lit(0.0)
    out = out.withColumns(
        {
            "sensor_class": F.when(F.col("_degenerate"), F.lit(CLASS_NOT)).otherwise(winner),
            "sensor_p_pothole": F.when(F.col("_degenerate"), F.lit(0.0)).otherwise(pothole),
            "sensor_severity": features.severity(
                F.col("magnitude"), F.col("speed_mps"), model.pace_floor, model.impact_scale
            ),
        }
    )
    dropped = ["_z0", "_z1", "_total", *[f"_d{i}" for i in range(len(model.components))], *names.values()]
    return out.drop(*dropped)
