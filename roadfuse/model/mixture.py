"""Gaussian-mixture fit of the two classifier features and the component-to-class rule."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.config import CLASSES
from roadfuse.functions import features
from roadfuse.functions.posterior import z_score
from roadfuse.model.artifact import Component

#: Rows that the starts of all restarts are chosen from; passes over the data at most; added to every variance.
START_ROWS, MAX_PASSES, FLOOR = 2048, 100, 1e-6
#: A restart stops once its log-likelihood per row grows by less than this.
_TOLERANCE = 1e-3


class FitError(RuntimeError):
    """Too few rows, or no variety, to fit the model."""


class FitStats(NamedTuple):
    """Rows, and mean and deviation of the two features."""

    n: int
    centre: tuple[float, float]
    spread: tuple[float, float]


class Mixture(NamedTuple):
    components: tuple[Component, ...]
    log_likelihood: float
    bic: float


def fittable(observations: DataFrame) -> DataFrame:
    return observations.filter(F.col("magnitude").isNotNull() & F.col("accel_std").isNotNull()).select(
        "client_id", "magnitude", "accel_std", "gbar_in_max", "speed_mps"
    )


def feature_stats(rows: DataFrame) -> DataFrame:
    """Row count, means and population deviations in one pass."""
    ratio, gbar = features.classifier_features(F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"))
    return rows.select(ratio.alias("ratio"), gbar.alias("gbar")).agg(
        F.count("*").alias("n"),
        F.avg("ratio").alias("ratio_mean"),
        F.stddev_pop("ratio").alias("ratio_std"),
        F.avg("gbar").alias("gbar_mean"),
        F.stddev_pop("gbar").alias("gbar_std"),
    )


def check_fittable(rows: DataFrame, k: int) -> FitStats:
    r = feature_stats(rows).first()
    if r.n < k:
        raise FitError(f"{r.n} rows are too few for {k} components")
    if max(r.ratio_std, r.gbar_std) <= 0:
        raise FitError("all rows have the same features")
    return FitStats(r.n, (r.ratio_mean, r.gbar_mean), (r.ratio_std, r.gbar_std))


def bic(log_likelihood: float, n: int, k: int, d: int = 2) -> float:
    free = (k - 1) + k * d + k * d * (d + 1) // 2
    return -2.0 * log_likelihood + free * math.log(n)


def standard_points(rows: DataFrame, stats: FitStats) -> DataFrame:
    """The standardised features z0 and z1, and a hash of the row's id that starts are chosen by."""
    both = features.classifier_features(F.col("magnitude"), F.col("accel_std"), F.col("gbar_in_max"))
    z = [z_score(x, m, s).alias(f"z{i}") for i, (x, m, s) in enumerate(zip(both, stats.centre, stats.spread))]
    return rows.select(*z, F.md5("client_id").alias("h"))


def distinct_points(points: DataFrame) -> DataFrame:
    """Every point once, with the number of its rows as ``n``: sensors report rounded values, so passes need not meet each row."""
    return points.groupBy("z0", "z1").agg(F.count("*").cast("double").alias("n"))


class Parameters:
    """Weights, means and covariances of several restarts at once: arrays of (restart, component, ...)."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray):
        self.weight, self.mean, self.cov = weight, mean, cov

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """(restart, component, row): log of each weighted density. Rows come last, so that numpy runs along them."""
        a, b, d = self.cov[..., 0, 0, None], self.cov[..., 0, 1, None], self.cov[..., 1, 1, None]
        det = a * d - b * b
        d0, d1 = x[:, 0] - self.mean[..., 0, None], x[:, 1] - self.mean[..., 1, None]
        q = d0 * d0
        q *= d / det
        d0 *= d1
        d0 *= -2 * b / det
        q += d0
        d1 *= d1
        d1 *= a / det
        q += d1
        q *= -0.5
        q += np.log(self.weight)[..., None] - math.log(2 * math.pi) - 0.5 * np.log(det)
        return q

    def statistics(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(restart, component, 7): shares, their first and second moments, and the log-likelihood in the first component; row i counts ``n[i]`` times."""
        share = self.log_density(x)
        top = share.max(1)
        share -= top[:, None]
        np.exp(share, out=share)
        whole = share.sum(1)
        share *= (n / whole)[:, None]
        moments = np.column_stack([np.ones(len(x)), x, x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2])
        out = np.zeros((*self.weight.shape, 7))
        out[..., :6] = share @ moments
        out[:, 0, 6] = (top + np.log(whole)) @ n
        return out

    @classmethod
    def maximised(cls, s: np.ndarray) -> Parameters:
        n = np.maximum(s[..., 0], 1e-12)
        mean = s[..., 1:3] / n[..., None]
        second = s[..., [3, 4, 4, 5]].reshape(*s.shape[:2], 2, 2) / n[..., None, None]
        cov = second - mean[..., :, None] * mean[..., None, :]
        cov[..., [0, 1], [0, 1]] = np.maximum(cov[..., [0, 1], [0, 1]], 0) + FLOOR
        # Rounding may leave a correlation just above one.
        most = np.sqrt(cov[..., 0, 0] * cov[..., 1, 1]) * (1 - 1e-9)
        cov[..., 0, 1] = cov[..., 1, 0] = np.clip(cov[..., 0, 1], -most, most)
        return cls(n / n.sum(1, keepdims=True), mean, cov)


def _starts(sample: np.ndarray, k: int, seed: int, restarts: int) -> Parameters:
    """Spread-out means drawn from the sample, each restart by its own generator, and the clusters around them."""
    all_stats = np.zeros((restarts, k, 7))
    for r in range(restarts):
        rng = np.random.default_rng([seed, r])
        means = [sample[rng.integers(len(sample))]]
        while len(means) < k:
            gap = np.min([((sample - m) ** 2).sum(1) for m in means], axis=0)
            means.append(sample[rng.choice(len(sample), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(sample))])
        near = np.argmin([((sample - m) ** 2).sum(1) for m in means], axis=0)
        for j in range(k):
            x = sample[near == j] if (near == j).any() else means[j][None, :]
            all_stats[r, j, :6] = len(x), *x.sum(0), (x[:, 0] ** 2).sum(), (x[:, 0] * x[:, 1]).sum(), (x[:, 1] ** 2).sum()
    return Parameters.maximised(all_stats)


def expectation(points: DataFrame, now: Parameters) -> np.ndarray:
    """Sums of ``statistics`` over all rows, or over distinct points with their ``n``; one row of sums per task is added up."""
    parts, shape = (now.weight, now.mean, now.cov), (*now.weight.shape, 7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(shape), Parameters(*parts)
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy() for i in (0, 1)])
            n = batch.column(2).to_numpy()
            for lo in range(0, len(x), 2048):
                total += own.statistics(x[lo : lo + 2048], n[lo : lo + 2048])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    n = F.col("n") if "n" in points.columns else F.lit(1.0).alias("n")
    sums = points.select("z0", "z1", n).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(math.prod(shape))
    for row in sums:
        out[row.i] = row.v
    return out.reshape(shape)


def fit_mixture(rows: DataFrame, stats: FitStats, k: int, seed: int, restarts: int) -> Mixture:
    """Best of ``restarts`` full-covariance fits; components come out by their energy.

    Expectation maximisation over the distinct points: one aggregation per pass serves all restarts that still move. Starts
    are drawn from the ``START_ROWS`` rows with the smallest md5 of their id, so neither they nor the result depend on
    how rows are dealt out. Components are ordered by the squared length of their mean, then by
    weight; the first is the first class, and those beyond the taxonomy share its last.
    """
    every = standard_points(rows, stats)
    start = every.orderBy("h", "z0", "z1").limit(START_ROWS).select("z0", "z1").collect()
    points = distinct_points(every).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        now = _starts(np.array([(r.z0, r.z1) for r in start]), k, seed, restarts)
        likelihood, moving = np.full(restarts, -np.inf), np.arange(restarts)
        for _ in range(MAX_PASSES):
            part = Parameters(now.weight[moving], now.mean[moving], now.cov[moving])
            sums = expectation(points, part)
            better = Parameters.maximised(sums)
            now.weight[moving], now.mean[moving], now.cov[moving] = better.weight, better.mean, better.cov
            gain = sums[:, 0, 6] - likelihood[moving]
            likelihood[moving] = sums[:, 0, 6]
            moving = moving[gain >= _TOLERANCE * stats.n]
            if not len(moving):
                break
        likelihood = expectation(points, now)[:, 0, 6]
    finally:
        points.unpersist()
    best = int(np.argmax(likelihood))
    energy = (now.mean[best] ** 2).sum(1)
    labels = [*CLASSES, *[CLASSES[-1]] * k]
    components = tuple(
        Component(tuple(map(float, now.mean[best, i])), tuple(tuple(map(float, row)) for row in now.cov[best, i]), float(now.weight[best, i]), label)
        for label, i in zip(labels, sorted(range(k), key=lambda i: (energy[i], now.weight[best, i])))
    )
    return Mixture(components, float(likelihood[best]), bic(float(likelihood[best]), stats.n, k))
