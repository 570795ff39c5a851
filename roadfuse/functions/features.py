"""Sensor features and the speed-normalised severity proxy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLASSIFIER_FEATURES = ("ratio", "gbar")
OUTLIER_FEATURES = ("ratio", "gbar", "magnitude", "accel_std", "speed_mps")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def ratio(magnitude: Column, accel_std: Column) -> Column:
    """Peak magnitude over baseline noise; 0 where there is no usable noise floor."""
    usable = magnitude.isNotNull() & accel_std.isNotNull() & (accel_std > 0.0)
    return F.when(usable, magnitude / accel_std).otherwise(0.0)


def classifier_features(magnitude: Column, accel_std: Column, gbar: Column) -> list[Column]:
    return [ratio(magnitude, accel_std), _or_zero(gbar)]


def outlier_features(magnitude: Column, accel_std: Column, gbar: Column, speed: Column) -> list[Column]:
    return [
        *classifier_features(magnitude, accel_std, gbar),
        _or_zero(magnitude),
        _or_zero(accel_std),
        _or_zero(speed),
    ]


def severity(magnitude: Column, speed: Column, speed_ref: float, scale: float) -> Column:
    """Impact per unit of speed, clamped to [0, 1]; slow traffic counts as ``speed_ref``."""
    pace = F.greatest(_or_zero(speed), F.lit(0.0), F.lit(float(speed_ref)))
    impact = scale * magnitude / pace
    return F.when(magnitude > 0.0, F.least(F.greatest(impact, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
