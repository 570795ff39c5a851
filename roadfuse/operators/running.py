"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_byte(c: str) -> Column:
    """First byte of a hex digest, as a long."""
    return F.conv(F.substring(c, 1, 2), 16, 10).cast("long")


def running_total(
    rows: DataFrame, value: str, group: list[str], levels: list[str], order: list[str]
) -> DataFrame:
    """Adds ``running``: the sum of ``value`` up to and with each row of its group.

    ``levels`` are nested columns, coarse to fine; ``order`` ranks the rows of one finest
    slice. Sums are taken per slice and then up the levels, so every window sorts either the
    children of one node or the rows of one slice; a group of any size never meets in one task.
    """
    keys = [group + levels[: d + 1] for d in range(len(levels))]
    sums = [rows.groupBy(*keys[-1]).agg(F.sum(value).alias("_s"))]
    for k in reversed(keys[:-1]):
        sums.insert(0, sums[0].groupBy(*k).agg(F.sum("_s").alias("_s")))
    offset = None
    for depth, level in enumerate(levels):
        parent = keys[depth - 1] if depth else group
        before = Window.partitionBy(*parent).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        own = sums[depth].withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
        if offset is not None:
            own = (
                own.join(offset.withColumnRenamed("_o", "_up"), parent)
                .withColumn("_o", F.col("_o") + F.col("_up"))
                .drop("_up")
            )
        offset = own
    inside = Window.partitionBy(*keys[-1]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_in", F.sum(value).over(inside))
        .join(offset, keys[-1])
        .withColumn("running", F.col("_in") + F.col("_o"))
        .drop("_in", "_o")
    )
