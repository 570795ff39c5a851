"""Session helpers: defaults for local runs and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", app: str = "roadfuse", **conf) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session, as ``spark.checkpoint.dir`` names it.

    A cluster must name one, and should set ``spark.cleaner.referenceTracking.cleanCheckpoints``
    so that rounds of a loop don't stay for ever. Only where driver and tasks are one process
    (``local[...]``: tests, notebooks) is a folder made if none is named.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="roadfuse-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose values are computed once, however often later steps use them.

    Plain projected expressions are copied into every filter and projection above them; for
    long ones (rule lists, parsed text) that multiplies the work. A generator is not merged.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*kept, *[e.alias(n) for n, e in columns.items()]))))
