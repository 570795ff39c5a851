"""Stored tables as partitioned Parquet folders.

Appended tables: ``<root>/<table>/batch=<id>``, with ``day=<n>`` below it for tables that have an arrival time (days since
1970 of ``received_at``). A batch that is repeated replaces its own folder. Every append of
observations or frames also stores its ids by bucket and a filter over them (``operators.idfilter``).

Keyed tables live in groups: ``<root>/<group>/of=<buckets>/part=<table>/day=<n>/bucket=<n>``. A change rewrites
the (day, bucket) partitions it touches, for all tables of the group in one job with one commit, by
Spark's dynamic partition overwrite. Each rewritten partition holds one row without a key, so that a
partition that loses all its rows is replaced, too.

Work queues: a batch of a source table is open until a run records it in ``closed_batch``; what a run closed
itself is still open to its repetition.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadfuse.operators import idfilter
from roadfuse.schema import table_schema
from roadfuse.session import cut_lineage

DATED = ("observation", "frame", "observation_score", "frame_processed")
WITH_IDS = ("observation", "frame")
#: Group -> its tables and their keys. Buckets are made of the key; maxima and tiles lie in the bucket of the rows they sum up.
GROUPS = {"pairing": {"fusion_pair": "frame_client_id", "fused_max": "client_id"}, "clusters": {"cluster": "cluster_id", "cluster_link": "cluster_id", "tile_part": "asset_type"}}
_GROUP_OF = {name: group for group, names in GROUPS.items() for name in names}
_DAY_US = 86_400_000_000
#: Tasks that share the rewriting of one folder.
PIECES = 4

Partition = tuple[int | None, int]


def folder_name(batch: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]", "_", batch)


def day_of(at: Column | str) -> Column:
    """Days since 1970 of an instant, whatever the session's time zone."""
    return F.floor(F.unix_micros(at) / _DAY_US).cast("int")


def day_number(at: datetime.datetime) -> int:
    return int(at.timestamp() // 86_400)


class Tables:
    """``buckets`` and ``pages`` (of the id filters) are part of the layout: keep them for the life of a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, pages: int = 4096):
        self.spark, self.root, self.buckets, self.pages = spark, root.rstrip("/"), buckets, pages

    # ── folders ────────────────────────────────────────────────────────────────

    def _folders(self, path: str, key: str) -> list[str]:
        """Values of the ``key=value`` folders directly below ``path``."""
        base = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(base))
        return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}="))

    def _remove(self, path: str) -> None:
        old = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def _load(self, base: str, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths)

    # ── appended tables ────────────────────────────────────────────────────────

    def batches(self, name: str) -> list[str]:
        return self._folders(f"{self.root}/{name}", "batch")

    def append(self, name: str, rows: DataFrame, batch: str) -> None:
        """Stores a batch, in place of its earlier attempt. Tables with days take ``day``, else the day of ``received_at``, else none."""
        path = f"{self.root}/{name}/batch={folder_name(batch)}"
        fitted = _fit(rows, name, ["day"] if name in DATED and "day" in rows.columns else [])
        if name not in DATED:
            fitted.write.mode("overwrite").parquet(path)
            return
        if "day" not in rows.columns:
            day = day_of("received_at") if "received_at" in rows.columns else F.lit(None).cast("int")
            fitted = _fit(rows.withColumn("day", day), name, ["day"])
        fitted.write.mode("overwrite").partitionBy("day").parquet(path)
        if name in WITH_IDS:
            self._append_ids(name, batch)

    def read(
        self, name: str, but_not: str | None = None, since: int | None = None, days: list | None = None, batches: list[str] | None = None, partitions: bool = False
    ) -> DataFrame:
        """The table, or some of its partitions.

        ``but_not`` leaves out one batch (the one about to be repeated), ``since`` days before it, ``days`` all others;
        rows without a day are always there. ``batches`` names folders to read. With ``partitions`` the columns batch and day
        (day and bucket of keyed tables) stay.
        """
        if name in _GROUP_OF:
            return self._read_keyed(name, since, partitions)
        held = self.batches(name) if batches is None else [b for b in batches if b in set(self.batches(name))]
        dated = name in DATED
        extra = [("batch", T.StringType()), *([("day", T.IntegerType())] if dated else [])]
        schema = T.StructType([*table_schema(name).fields, *[T.StructField(*e) for e in extra]])
        if not held:
            rows = self.spark.createDataFrame([], schema)
        else:
            base = f"{self.root}/{name}"
            rows = self._load(base, [base] if batches is None else [f"{base}/batch={b}" for b in held], schema)
        if but_not is not None:
            rows = rows.filter(F.col("batch") != folder_name(but_not))
        if since is not None:
            rows = rows.filter((F.col("day") >= since) | F.col("day").isNull())
        if days is not None:
            rows = rows.filter(F.col("day").isin([d for d in days if d is not None]) | F.col("day").isNull())
        return rows if partitions else rows.select(*table_schema(name).names)

    def remove_rows_where(self, name: str, gone: Column) -> None:
        """Removes the rows that meet a condition on their own columns; only (batch, day) partitions that hold such rows are rewritten.

        Nothing is shuffled or stored in between: every task copies what it reads, and the new files take the old ones' place when the
        job commits. Partitions that lose all rows are removed after that.
        """
        base, folders = f"{self.root}/{name}", ["batch", "day"] if name in DATED else ["batch"]
        rows, hit = self.read(name, partitions=True), F.coalesce(gone, F.lit(False))
        sums = rows.groupBy(*folders).agg(F.count("*").alias("n"), F.count_if(hit).alias("gone")).filter("gone > 0").collect()
        smaller = [tuple(r[f] for f in folders) for r in sums if r.gone < r.n]
        if smaller:
            names = [f"_{f}" for f in folders]
            fields = [T.StructField(n, rows.schema[f].dataType) for f, n in zip(folders, names)]
            named = F.broadcast(self.spark.createDataFrame(smaller, T.StructType(fields)))
            same = reduce(and_, [rows[f].eqNullSafe(named[n]) for f, n in zip(folders, names)])
            kept = rows.join(named, same, "left_semi").filter(~hit)
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(base)
        for r in sums:
            if r.gone == r.n:
                self._remove("/".join([base, *[f"{f}={'__HIVE_DEFAULT_PARTITION__' if r[f] is None else r[f]}" for f in folders]]))

    def remove_rows(self, name: str, gone: DataFrame, touched: list[tuple[str, int | None]], key: str = "client_id") -> None:
        """Rewrites the (batch, day) partitions ``touched`` without the rows whose ``key`` is in ``gone``; day is None in tables without days.

        Partitions that lose all rows are removed after the others are replaced.
        """
        if not touched:
            return
        base, dated = f"{self.root}/{name}", name in DATED
        folders = ["batch", "day"] if dated else ["batch"]
        rows = self.read(name, batches=sorted({b for b, _ in touched}), partitions=True)
        if dated:
            named = self.spark.createDataFrame(touched, "batch STRING, _day INT")
            rows = rows.join(F.broadcast(named), (rows["batch"] == named["batch"]) & rows["day"].eqNullSafe(named["_day"]), "left_semi")
        kept = cut_lineage(rows.join(gone.select(key), key, "left_anti").select(rows.columns))
        left = {tuple(r) for r in kept.select(*folders).distinct().collect()}
        kept.repartition(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(base)
        for batch, day in touched:
            if (batch, day) not in left and (batch,) not in left:
                self._remove(f"{base}/batch={batch}" + (f"/day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}" if dated else ""))

    # ── ids ────────────────────────────────────────────────────────────────────

    def _append_ids(self, name: str, batch: str) -> None:
        ids = self.read(name, batches=[folder_name(batch)]).select("client_id")
        place = f"{self.root}/{{}}/resource={name}/batch={folder_name(batch)}"
        bucketed = ids.withColumn("bucket", idfilter.bucket(F.col("client_id"), self.buckets))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(place.format("known_id"))
        idfilter.build(ids, self.pages).coalesce(1).write.mode("overwrite").parquet(place.format("id_filter"))

    def id_filters(self, name: str, but_not: str | None = None) -> DataFrame:
        """(page, bits) of every stored batch; pages of one number are to be merged."""
        base = f"{self.root}/id_filter/resource={name}"
        schema = T.StructType.fromDDL("page INT, bits BINARY, batch STRING")
        if not self._folders(base, "batch"):
            return self.spark.createDataFrame([], "page INT, bits BINARY")
        rows = self._load(base, [base], schema)
        return (rows if but_not is None else rows.filter(F.col("batch") != folder_name(but_not))).select("page", "bits")

    def known_ids(self, name: str, buckets: list[int], but_not: str | None = None) -> DataFrame:
        """Stored ids (client_id) of some buckets."""
        base = f"{self.root}/known_id/resource={name}"
        rows = self._load(base, [base], T.StructType.fromDDL("client_id STRING, batch STRING, bucket INT")).filter(F.col("bucket").isin(buckets))
        return (rows if but_not is None else rows.filter(F.col("batch") != folder_name(but_not))).select("client_id")

    def merge_id_filters(self, name: str) -> None:
        """All filters of a table as one; a reader meanwhile sees parts twice, which changes no answer."""
        base = f"{self.root}/id_filter/resource={name}"
        old = self._folders(base, "batch")
        number = 1 + max([int(b.removeprefix("merged-")) for b in old if b.startswith("merged-")], default=0)
        idfilter.merge(self.id_filters(name)).coalesce(1).write.mode("overwrite").parquet(f"{base}/batch=merged-{number:09d}")
        for batch in old:
            self._remove(f"{base}/batch={batch}")

    def forget_ids(self, name: str, ids: DataFrame) -> None:
        """Takes ids from the stored ones, so that they may come again; the filters keep them, which only costs a look."""
        base = f"{self.root}/known_id/resource={name}"
        if not self._folders(base, "batch"):
            return
        buckets = [r.b for r in ids.select(idfilter.bucket(F.col("client_id"), self.buckets).alias("b")).distinct().collect()]
        schema = T.StructType.fromDDL("client_id STRING, batch STRING, bucket INT")
        rows = self._load(base, [base], schema).filter(F.col("bucket").isin(buckets))
        touched = rows.join(ids, "client_id", "left_semi").select("batch", "bucket").distinct().collect()
        if not touched:
            return
        named = self.spark.createDataFrame([tuple(r) for r in touched], "batch STRING, bucket INT")
        kept = cut_lineage(rows.join(F.broadcast(named), ["batch", "bucket"], "left_semi").join(ids, "client_id", "left_anti").select("client_id", "batch", "bucket"))
        left = {tuple(r) for r in kept.select("batch", "bucket").distinct().collect()}
        kept.repartition("batch", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(base)
        for batch, bucket in touched:
            if (batch, bucket) not in left:
                self._remove(f"{base}/batch={batch}/bucket={bucket}")

    # ── work queues ────────────────────────────────────────────────────────────

    def open_batches(self, name: str, run: str | None = None) -> dict[str, list[int | None]]:
        """Batches of ``name`` that no run but ``run`` has closed, and their days."""
        closed = {
            r.closed for r in self.read("closed_batch", but_not=run).filter(F.col("source") == name).select("closed").collect()
        }  # names of folders, one row a batch
        days = lambda b: [int(d) if d.lstrip("-").isdigit() else None for d in self._folders(f"{self.root}/{name}/batch={b}", "day")]
        return {b: days(b) for b in self.batches(name) if b not in closed}

    def close_batches(self, name: str, batches: list[str], run: str) -> None:
        rows = self.spark.createDataFrame([(name, b) for b in batches], table_schema("closed_batch"))
        self.append("closed_batch", rows, f"{run}-{name}")

    # ── keyed tables ───────────────────────────────────────────────────────────

    def placed(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a keyed table with the day (none, if they have no such column) and bucket that hold them."""
        key = GROUPS[_GROUP_OF[name]][name]
        day = F.col("day") if "day" in rows.columns else F.lit(None)
        return rows.withColumns({"day": day.cast("int"), "bucket": idfilter.bucket(F.col(key), self.buckets)})

    def partitions_of(self, rows: DataFrame) -> list[Partition]:
        """The partitions ``rows`` (placed) touch: at most one a day and bucket."""
        return sorted(((r.day, r.bucket) for r in rows.select("day", "bucket").distinct().collect()), key=str)

    def _group_folder(self, name: str) -> str:
        return f"{self.root}/{_GROUP_OF.get(name, name)}/of={self.buckets}"

    def _read_keyed(self, name: str, since: int | None = None, partitions: bool = False, at: list[Partition] | None = None) -> DataFrame:
        base = f"{self._group_folder(name)}/part={name}"
        schema = T.StructType([*table_schema(name).fields, T.StructField("day", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
        paths = [base] if self._folders(base, "day") else []
        if at is not None:
            folder = lambda p: f"{base}/day={'__HIVE_DEFAULT_PARTITION__' if p[0] is None else p[0]}"
            there = {d: set(self._folders(d, "bucket")) for d in {folder(p) for p in at}}
            paths = [f"{folder(p)}/bucket={p[1]}" for p in at if str(p[1]) in there[folder(p)]]
        rows = self._load(base, paths, schema) if paths else self.spark.createDataFrame([], schema)
        if since is not None:
            rows = rows.filter((F.col("day") >= since) | F.col("day").isNull())
        rows = rows.filter(F.col(GROUPS[_GROUP_OF[name]][name]).isNotNull())
        return rows if partitions else rows.select(*table_schema(name).names)

    def read_partitions(self, name: str, at: list[Partition]) -> DataFrame:
        """Rows of a keyed table in some partitions, with day and bucket; nothing else is listed or read."""
        return self._read_keyed(name, partitions=True, at=at)

    def _dealt(self, rows: DataFrame, folders: list[str], spread: Column) -> DataFrame:
        """Rows dealt to tasks by folder, those of one folder to ``PIECES`` tasks by ``spread``: neither a large folder nor many small ones wait for one task."""
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        return rows.repartition(tasks, *folders, F.pmod(F.xxhash64(spread), F.lit(PIECES)))

    def rewrite(self, group: str, tables: dict[str, DataFrame], at: list[Partition]) -> None:
        """Replaces the partitions ``at`` of some tables of a group, in one job: readers see the old rows of all of them or the new ones.

        Rows must be all that these partitions hold from now on, with day and bucket.
        """
        whole = None
        for name, rows in tables.items():
            schema = T.StructType([T.StructField("day", T.IntegerType()), T.StructField("bucket", T.IntegerType())])
            marks = _fit(self.spark.createDataFrame([tuple(p) for p in at], schema), name, ["day", "bucket"], missing=True)
            part = _fit(rows, name, ["day", "bucket"]).unionByName(marks).withColumn("part", F.lit(name))
            whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
        folders = ["part", "day", "bucket"]
        # Links have no days and far more rows than clusters; null in all other tables.
        spread = F.col("member_id") if "cluster_link" in tables else F.lit(None)
        whole = self._dealt(whole, folders, spread) if len(at) > 1 else whole.coalesce(1)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.root}/{group}/of={self.buckets}")


def _fit(rows: DataFrame, name: str, more: list[str], missing: bool = False) -> DataFrame:
    """The table's columns and types, then ``more``."""
    own = lambda f: F.lit(None) if missing and f.name not in rows.columns else F.col(f.name)
    return rows.select(*[own(f).cast(f.dataType).alias(f.name) for f in table_schema(name).fields], *more)
