"""Exact interpolated quantiles of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins per pass; so many rows of counts reach the driver.
BINS = 4096


def _at_rank(values: DataFrame, rank: int, low: float, high: float) -> float:
    """The value of ascending rank ``rank`` (from 0) among those in [low, high]; each pass looks into one bin of the last."""
    while low < high:
        # Bins are at least one step of a double wide, as their bounds are values of the column.
        place = F.least(F.floor((F.col("v") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        inside = values.filter(F.col("v").between(low, high))
        bins = inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for b in sorted(bins.collect(), key=lambda b: b.low):
            if rank < b.n:
                break
            rank -= b.n
        if (b.low, b.high) == (low, high):  # neighbouring doubles only
            return low if rank < inside.filter(F.col("v") == low).count() else high
        low, high = b.low, b.high
    return low


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """Linear interpolation between the two ranks around ``q * (n - 1)``; None for no values. Nulls are left out."""
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    r = values.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not r.n:
        return None
    at = q * (r.n - 1)
    below = math.floor(at)
    a = _at_rank(values, below, r.low, r.high)
    b = _at_rank(values, below + 1, r.low, r.high) if at > below else a
    return a + (at - below) * (b - a)
