"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadfuse.session import use_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``; nothing is created yet."""
    return f"{use_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bounds Arrow batches: a thousand long texts already fill a task's share of an executor outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again.

    Cuts the lineage: what follows reads files, so a lost executor costs no earlier step, and a
    table that several steps read is computed once.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI, for raw files that no Spark writer makes."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def publish(uri: str, write) -> int:
    """Calls ``write(stream)`` on a private name and then moves the file to ``uri``; its size.

    A task that is retried or runs twice replaces the file by an equal one, and a reader never
    sees half a file.
    """
    system, path = file_system(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    private = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(private) as stream:
        write(stream)
    system.move(private, path)
    return system.get_file_info(path).size


def remembered(key: tuple, make: Callable):
    """``make()``, once per Python worker and key. Task functions travel by value, so module globals last one task only."""
    memory = sys.modules.setdefault("roadfuse_worker_memory", types.ModuleType("roadfuse_worker_memory")).__dict__
    if key not in memory:
        memory[key] = make()
    return memory[key]


def _give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; it has its own ways


def freed_group(run: Callable) -> Callable:
    """``run`` (Arrow table to Arrow table), giving memory back to the system after each group of a megabyte or more."""

    def own(table):
        out = run(table)
        if table.nbytes >= 1 << 20:
            _give_back()
        return out

    return own


def freed(run: Callable) -> Callable:
    """``run`` (Arrow batches to Arrow batches), giving memory back to the system when a task ends: idle workers else keep what their largest batch took."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return own


def slices(batch, column: int, size: int = 1 << 20):
    """Parts of an Arrow batch with about ``size`` bytes of text in ``column``, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, start = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + size, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts: what the number of buckets and files is derived from."""
    from pyspark.sql import functions as F

    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def power_of_two(x: float, least: int = 1) -> int:
    return max(least, 1 << max(0, int(x) - 1).bit_length())
