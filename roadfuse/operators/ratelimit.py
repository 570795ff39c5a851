"""Sliding-hour request limit per (device, resource) over one-minute buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadfuse.operators.running import hash_byte, running_total

# Fixed values.
BUCKET_SECONDS = 60
WINDOW_SECONDS = 3600

_KEY = ["device_id", "resource"]


def bucket_start(us: Column) -> Column:
    return F.floor(us / (BUCKET_SECONDS * 1_000_000)) * BUCKET_SECONDS


def bucket_counts(requests: DataFrame) -> DataFrame:
    """The ``device_rate_limit`` rows of a batch of requests."""
    start = F.timestamp_seconds(bucket_start(F.unix_micros("received_at")))
    return requests.groupBy(*_KEY, start.alias("window_start")).agg(
        F.sum("n").cast("long").alias("request_count")
    )


def check_rate_limit(
    requests: DataFrame,
    limits: dict[str, int],
    prior: DataFrame | None = None,
) -> DataFrame:
    """Requests (``device_id, resource, request_id, received_at, n``) with ``current``, ``limit``, ``allowed``.

    A request counts before it is checked, so refused ones count too. A bucket is inside the
    window while its start is not older than one hour, which lets a request exactly on a
    minute see one bucket more. ``prior`` carries the stored buckets of earlier batches.
    Requests of one device in the same microsecond are taken in ``md5(request_id)`` order.

    Requests are summed in slices of a millisecond and a hash, so that no task holds a whole minute of a device.
    """
    us = F.unix_micros("received_at")
    # Resources without a limit pass unchecked.
    limit = F.coalesce(*[F.when(F.col("resource") == r, F.lit(n)) for r, n in limits.items()])
    rows = requests.withColumns(
        {"us": us, "bucket": bucket_start(us), "_md5": F.md5("request_id"), "limit": limit}
    )
    per_bucket = rows.groupBy(*_KEY, "bucket").agg(
        F.sum("n").alias("n"), F.lit(0).cast("long").alias("p")
    )
    counts = per_bucket
    if prior is not None:
        counts = counts.unionByName(
            prior.select(
                *_KEY,
                F.unix_seconds("window_start").alias("bucket"),
                F.lit(0).cast("long").alias("n"),
                F.col("request_count").alias("p"),
            )
        ).groupBy(*_KEY, "bucket").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))

    by_time = Window.partitionBy(*_KEY).orderBy("bucket")

    def earlier(seconds: int) -> Column:
        frame = by_time.rangeBetween(-seconds, -BUCKET_SECONDS)
        return F.coalesce(F.sum(F.col("n") + F.col("p")).over(frame), F.lit(0)) + F.col("p")

    before = counts.select(
        *_KEY,
        "bucket",
        earlier(WINDOW_SECONDS - BUCKET_SECONDS).alias("inside_hour"),
        earlier(WINDOW_SECONDS).alias("with_edge"),
    )

    rows = rows.withColumns({"ms": F.floor(F.col("us") / 1000), "slice": F.col("us") * 256 + hash_byte("_md5")})
    rows = running_total(rows, "n", [*_KEY, "bucket"], ["ms", "slice"], ["_md5", "request_id"]).drop("ms", "slice")

    on_minute = F.col("us") % (BUCKET_SECONDS * 1_000_000) == 0
    current = F.col("running") + F.when(on_minute, F.col("with_edge")).otherwise(F.col("inside_hour"))
    return (
        rows.join(before, [*_KEY, "bucket"])
        .withColumn("current", current)
        .withColumn("allowed", F.col("limit").isNull() | (F.col("current") <= F.col("limit")))
        .select(*requests.columns, "current", "limit", "allowed")
    )
