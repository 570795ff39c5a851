"""Consistency checks of the stored tables and data-quality figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCES = ("crowd", "verified", "ml")
KINDS = ("observation", "frame")
LATE_PAIR_MS = 2500  # fixed value
DISAGREEMENT = 0.3  # fixed value


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Values beyond the enumeration; NULL is allowed, as in a check constraint."""
    return df.filter(~F.col(column).isin(*allowed))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    keyed = child.filter(F.col(column).isNotNull())
    return keyed.join(parent.select(F.col(key).alias(column)), column, "left_anti")


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations), one row per check."""
    parts = [
        df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def integrity_checks(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Primary keys, required values, enumerations and foreign keys of the stored tables."""
    return {
        "observation_key": duplicate_keys(t["observation"], ["client_id"]),
        "observation_required": missing_values(
            t["observation"], ["client_id", "device_id", "ts_utc", "lat", "lon", "confidence", "received_at"]
        ),
        "frame_key": duplicate_keys(t["frame"], ["client_id"]),
        "frame_required": missing_values(
            t["frame"], ["client_id", "device_id", "ts_utc", "lat", "lon", "jpeg_url", "received_at"]
        ),
        "pair_key": duplicate_keys(t["fusion_pair"], ["event_client_id", "frame_client_id"]),
        "pair_observation": orphans(t["fusion_pair"], "event_client_id", t["observation"], "client_id"),
        "pair_frame": orphans(t["fusion_pair"], "frame_client_id", t["frame"], "client_id"),
        "cluster_key": duplicate_keys(t["cluster"], ["cluster_id"]),
        "cluster_source": outside(t["cluster"], "source", SOURCES),
        "link_key": duplicate_keys(t["cluster_link"], ["cluster_id", "member_id", "kind"]),
        "link_kind": outside(t["cluster_link"], "kind", KINDS),
        "link_cluster": orphans(t["cluster_link"], "cluster_id", t["cluster"], "cluster_id"),
    }


def integrity_counts(t: dict[str, DataFrame]) -> DataFrame:
    """(check_name, violations) of ``integrity_checks``; what single rows can tell is counted in one pass a table, as is what one key's rows can."""
    null = lambda *cs: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
    beyond = lambda c, allowed: F.coalesce(~F.col(c).isin(*allowed), F.lit(False))
    # Per table: the key, and (check, rule) of single rows. Rows are summed per key before the shuffle.
    rules = {
        "observation": ("observation_key", ["client_id"], "observation_required", null("client_id", "device_id", "ts_utc", "lat", "lon", "confidence", "received_at")),
        "frame": ("frame_key", ["client_id"], "frame_required", null("client_id", "device_id", "ts_utc", "lat", "lon", "jpeg_url", "received_at")),
        "cluster": ("cluster_key", ["cluster_id"], "cluster_source", beyond("source", SOURCES)),
        "cluster_link": ("link_key", ["cluster_id", "member_id", "kind"], "link_kind", beyond("kind", KINDS)),
    }
    parts = []
    for name, (unique, keys, rule, broken) in rules.items():
        per_key = t[name].groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(broken).alias("broken"))
        both = per_key.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum("broken"), F.lit(0)).alias("broken"))
        parts.append(
            both.select(
                F.inline(
                    F.array(
                        F.struct(F.lit(unique).alias("check_name"), F.col("repeated").alias("violations")),
                        F.struct(F.lit(rule).alias("check_name"), F.col("broken").alias("violations")),
                    )
                )
            )
        )
    all_checks = integrity_checks(t)
    rest = ("pair_key", "pair_observation", "pair_frame", "link_cluster")
    return reduce(DataFrame.unionByName, [*parts, counted({name: all_checks[name] for name in rest})])


def pairing_quality(
    observations: DataFrame, frames: DataFrame, pairs: DataFrame, clusters: DataFrame
) -> dict[str, DataFrame]:
    """Unpaired rows, late pairs and single-device clusters."""
    by_event = pairs.select(F.col("event_client_id").alias("client_id"))
    by_frame = pairs.select(F.col("frame_client_id").alias("client_id"))
    return {
        "observations_unpaired": observations.join(by_event, "client_id", "left_anti"),
        "frames_unpaired": frames.join(by_frame, "client_id", "left_anti"),
        "pairs_late": pairs.filter(F.abs("delta_ms") > LATE_PAIR_MS),
        "clusters_single_device": clusters.filter("distinct_devices = 1"),
    }


def ingest_rate_anomalies(rows: DataFrame, spread: float = 3.0) -> DataFrame:
    """Hours whose arrivals leave the mean by more than ``spread`` deviations.

    Hourly counts are few however many rows there are; their mean and deviation are one row.
    """
    hourly = rows.groupBy(F.date_trunc("hour", "received_at").alias("hour")).agg(F.count("*").alias("n"))
    s = hourly.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation")).first()
    if s.mean is None:
        return hourly
    return hourly.filter(F.abs(F.col("n") - s.mean) > spread * s.deviation)


def model_disagreement(frames: DataFrame, device: str, server: str) -> DataFrame:
    """Frames where the on-device and the server probability differ by more than 0.3."""
    return frames.filter(F.abs(F.col(device) - F.col(server)) > DISAGREEMENT)


def compare_runs(before: DataFrame, after: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: how two fusion runs over the same data differ."""
    keys = ["event_client_id", "frame_client_id"]
    a = before.select(*keys, F.col("fused_confidence").alias("a"))
    b = after.select(*keys, F.col("fused_confidence").alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    flipped = both & ((F.col("a") >= threshold) != (F.col("b") >= threshold))
    return a.join(b, keys, "full").agg(
        F.count_if(both).alias("common"),
        F.count_if(F.col("b").isNull()).alias("only_before"),
        F.count_if(F.col("a").isNull()).alias("only_after"),
        F.count_if(flipped).alias("flipped"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_change"),
    )
