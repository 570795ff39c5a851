"""The fitted model as typed parameters, and its table form."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadfuse.schema import table_schema


@dataclass(frozen=True)
class Component:
    mu: tuple[float, float]
    sigma: tuple[tuple[float, float], tuple[float, float]]
    weight: float
    label: str


@dataclass(frozen=True)
class ForestNode:
    """Inner node: ``feature``/``threshold``/``left``/``right``. Leaf: ``feature`` is -1."""

    tree_id: int
    node_id: int
    feature: int
    threshold: float
    left: int
    right: int
    path_length: float


@dataclass(frozen=True)
class SensorModel:
    version: str
    components: tuple[Component, ...]
    #: Mean and deviation of the two classifier features, in their order.
    centre: tuple[float, float] = (0.0, 0.0)
    spread: tuple[float, float] = (1.0, 1.0)
    #: Speed below which severity stops growing, and impact per unit of speed that counts as 1.
    pace_floor: float = 5.0
    impact_scale: float = 2.0
    k: int = 3
    n_observations: int = 0
    bic: float | None = None
    # The forest is bounded: trees * (2 * sample - 1) nodes.
    forest: tuple[ForestNode, ...] = field(default=(), repr=False)
    forest_sample: int = 256
    outlier_threshold: float | None = None


def model_rows(spark: SparkSession, model: SensorModel, fitted_at: datetime.datetime) -> DataFrame:
    """The model as one row of ``sensor_model``."""
    row = (
        model.version,
        model.k,
        model.n_observations,
        model.bic,
        tuple(zip(model.centre, model.spread)),
        [(list(c.mu), [list(r) for r in c.sigma], c.weight, c.label) for c in model.components],
        (model.pace_floor, model.impact_scale),
        model.forest_sample,
        model.outlier_threshold,
        fitted_at,
    )
    return spark.createDataFrame([row], table_schema("sensor_model"))


def forest_rows(spark: SparkSession, model: SensorModel) -> DataFrame:
    rows = [
        (model.version, n.tree_id, n.node_id, n.feature, n.threshold, n.left, n.right, n.path_length)
        for n in model.forest
    ]
    return spark.createDataFrame(rows, table_schema("sensor_forest"))


def activation_rows(spark: SparkSession, version: str, at: datetime.datetime) -> DataFrame:
    """An activation event. The latest one names the active model; a rollback is a new event."""
    return spark.createDataFrame([(version, at)], table_schema("model_activation"))


def load_active(models: DataFrame, forests: DataFrame, activations: DataFrame) -> SensorModel | None:
    """The active model, or None. Reads one model row and its bounded forest."""
    latest = activations.agg(F.max_by("model_version", F.struct("activated_at", "model_version")).alias("v")).first()
    if latest is None or latest.v is None:
        return None
    r = models.filter(F.col("model_version") == latest.v).first()
    nodes = forests.filter(F.col("model_version") == latest.v).orderBy("tree_id", "node_id").collect()
    return SensorModel(
        version=r.model_version,
        centre=(r.standardization.ratio.mean, r.standardization.gbar.mean),
        spread=(r.standardization.ratio.std, r.standardization.gbar.std),
        components=tuple(
            Component(tuple(c.mu), tuple(tuple(row) for row in c.sigma), c.weight, c["class"])
            for c in r.components
        ),
        pace_floor=r.severity_calib.speed_ref,
        impact_scale=r.severity_calib.scale,
        k=r.k,
        n_observations=r.n_observations,
        bic=r.bic,
        forest=tuple(
            ForestNode(n.tree_id, n.node_id, n.feature, n.threshold, n.left, n.right, n.path_length)
            for n in nodes
        ),
        forest_sample=r.forest_sample,
        outlier_threshold=r.outlier_threshold,
    )
