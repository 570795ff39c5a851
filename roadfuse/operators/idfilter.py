"""Insert-if-absent through filters over stored ids, so that new ids cost no scan of old ones.

A filter is a Bloom filter in pages of 32,768 bits. An id belongs to one page and sets ``HASHES`` bits of it,
so filters are built by one aggregation, merge page by page, and a batch only meets the pages of its own ids. About
3,000 ids a page keep false answers near one in a hundred; beyond that more ids are looked up, and the answer stays exact.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadfuse.session import cut_lineage

if TYPE_CHECKING:
    from roadfuse.sources.tables import Tables

PAGE_BITS = 32_768
HASHES = 7


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(key: str, pages: int) -> tuple[Column, Column]:
    """(page, bits within it) of an id."""
    page = F.pmod(F.xxhash64(F.lit("page"), key), F.lit(pages)).cast("int")
    return page, F.array(*[F.pmod(F.xxhash64(F.lit(k), key), F.lit(PAGE_BITS)) for k in range(HASHES)])


def build(ids: DataFrame, pages: int, key: str = "client_id") -> DataFrame:
    """(page, bits) over all ids."""
    page, bits = _places(key, pages)
    return ids.select(page.alias("page"), F.explode(bits).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge(filters: DataFrame) -> DataFrame:
    """Filters of several batches as one."""
    return filters.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))


def perhaps_held(ids: DataFrame, filters: DataFrame, pages: int, key: str = "client_id") -> DataFrame:
    """The ids that ``filters`` may hold: all that they do hold, and few others."""
    page, bits = _places(key, pages)
    asked = ids.select(key, page.alias("page"), bits.alias("asked"))
    own = merge(filters.join(asked.select("page").distinct(), "page", "left_semi"))
    byte = lambda b: F.conv(F.hex(F.substring("bits", (b / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = lambda b: F.call_function("shiftright", byte(b), (b % 8).cast("int")).bitwiseAND(1) == 1
    return asked.join(own, "page").filter(F.forall("asked", is_set)).select(key)


class StoredIds:
    """The ids of a stored table as the target of an insert-if-absent. ``batch`` is the one being written: its earlier attempt does not count."""

    def __init__(self, tables: Tables, name: str, batch: str | None = None):
        self.tables, self.name, self.batch = tables, name, batch

    def absent(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose id is not stored yet. Stored ids are read only for buckets in which the filter suspects one."""
        filters = self.tables.id_filters(self.name, self.batch)
        suspects = cut_lineage(
            perhaps_held(rows.select(key), filters, self.tables.pages, key).withColumn("bucket", bucket(F.col(key), self.tables.buckets))
        )
        buckets = sorted(r.bucket for r in suspects.select("bucket").distinct().collect())
        if not buckets:
            return rows
        stored = self.tables.known_ids(self.name, buckets, self.batch).withColumnRenamed("client_id", key)
        return rows.join(stored.join(suspects.select(key), key, "left_semi"), key, "left_anti")
