"""Token files: independent zstandard frames, a document directory and a trailing seek table.

A file holds the ids of many documents as little-endian unsigned 32-bit integers, cut into frames
of ``FRAME_TOKENS`` ids (the last may be shorter). Two skippable frames follow: a directory (per
document: id, number of ids) and a seek table in the public seekable format, whose entries hold
each frame's packed size, plain size and checksum (the low 32 bits of XXH64). A reader takes the
seek table from the end of the file and unpacks only the frames that hold the wanted ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from roadfuse.llm.chunks import ChunkEncoder, encoded
from roadfuse.llm.shared import file_system, publish, remembered
from roadfuse.llm.wordhash import strings

FRAME_TOKENS = 65_536
#: Fixed values of the public seekable format.
_SEEK_TABLE, _DIRECTORY, _SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
_SLICE_BYTES = 2_000_000
_NO_ID = -(2**63)


class TokenFileWriter:
    """Writes one token file to a stream; holds one frame of ids and the directory."""

    def __init__(self, stream, level: int = 1, frame_tokens: int = FRAME_TOKENS):
        self._stream, self._pack, self._frame = stream, zstandard.ZstdCompressor(level=level, write_checksum=True), frame_tokens
        self._open: list[np.ndarray] = []
        self._held = 0
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int] = []
        self._counts: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._ids.append(_NO_ID if doc_id is None else doc_id)
        self._counts.append(len(ids))
        ids = ids.astype("<u4", copy=False)
        while len(ids):
            part = ids[: self._frame - self._held]
            self._open.append(part)
            self._held += len(part)
            ids = ids[len(part) :]
            if self._held == self._frame:
                self._flush()

    def _flush(self) -> None:
        plain = np.concatenate(self._open).tobytes()
        packed = self._pack.compress(plain)
        self._stream.write(packed)
        self._entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self._open, self._held = [], 0

    def close(self) -> None:
        if self._held:
            self._flush()
        directory = self._pack.compress(np.array(self._ids, "<i8").tobytes() + np.array(self._counts, "<u8").tobytes())
        self._stream.write(struct.pack("<II", _DIRECTORY, len(directory)) + directory)
        entries = [*self._entries, (8 + len(directory), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table = b"".join(struct.pack("<III", *x) for x in entries) + struct.pack("<IBI", len(entries), 0x80, _SEEKABLE)
        self._stream.write(struct.pack("<II", _SEEK_TABLE, len(table)) + table)


class TokenFileReader:
    """Reads a token file from a seekable file of known size."""

    def __init__(self, file, size: int):
        self._file = file
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self._packed, self._plain, self._sum = table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2]
        self._start = np.cumsum(self._packed) - self._packed
        directory = self._at(int(self._start[-1]) + 8, int(self._packed[-1]) - 8)
        both = zstandard.ZstdDecompressor().decompress(directory) if directory else b""
        half = len(both) // 2
        ids = np.frombuffer(both[:half], "<i8")
        self.counts = np.frombuffer(both[half:], "<u8").astype(np.int64)
        self.doc_ids = [None if x == _NO_ID else int(x) for x in ids.tolist()]
        self._first = np.cumsum(self.counts) - self.counts
        self._ends = np.cumsum(self._plain // 4)
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _at(self, start: int, length: int) -> bytes:
        self._file.seek(start)
        return self._file.read(length)

    def frame(self, k: int) -> np.ndarray:
        """Unpacks frame ``k``; a wrong checksum is an error."""
        if self._last[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self._at(int(self._start[k]), int(self._packed[k])), max_output_size=int(self._plain[k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self._sum[k]:
                raise ValueError(f"checksum of frame {k} is wrong")
            self._last = (k, np.frombuffer(plain, "<u4"))
        return self._last[1]

    def parts(self, row: int) -> Iterator[np.ndarray]:
        """The ids of the directory's document ``row``, frame by frame."""
        at, left = int(self._first[row]), int(self.counts[row])
        while left:
            k = int(np.searchsorted(self._ends, at, "right"))
            own = self.frame(k)
            start = at - int(self._ends[k]) + len(own)
            part = own[start : start + left]
            yield part
            at, left = at + len(part), left - len(part)


def _encoder(path: str) -> ChunkEncoder:
    """One per Python worker; the chunks it knows serve later tasks of the worker too."""
    return remembered(("tokens", path), lambda: ChunkEncoder(_chunk_ids(path)))


def _chunk_ids(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    width = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        width[i] = len(token)  # one character stands for one byte

    def encode(texts: list[bytes], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [
            np.array(x.ids, np.int32)
            for start in range(0, len(texts), 64)
            for x in tokenizer.encode_batch_fast([t.decode() for t in texts[start : start + 64]], add_special_tokens=False)
        ]
        ids = np.concatenate(found)
        return ids, np.diff(np.searchsorted(np.cumsum(width[ids]), ends, "right"), prepend=0)

    return encode


def write_tokens(docs: DataFrame, root: str, tokenizer_path: str, end_id: int = 0, files: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes token files below the URI ``root``, in doc_id order.

    Documents are dealt out by ranges of doc_id, so that file after file and row after row ids
    ascend; nulls come first, equal doc_ids are ordered by text. A null text counts as empty.
    Each document ends with ``end_id``. Special tokens that a text spells out, such as ``<|endoftext|>``, get
    their special ids, as from the tokenizer's plain call. ``files`` is the number of ranges; by default the
    session's number of shuffle partitions. Returns the manifest: file_no, path, n_docs, n_tokens, bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        no, seen = TaskContext.get().partitionId(), [0, 0]

        def fill(stream) -> None:
            writer = TokenFileWriter(stream)
            end = np.array([end_id], np.int32)
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for first, last, flat, counts in encoded(encoder, *strings(batch.column(1)), _SLICE_BYTES):
                    ends = np.cumsum(counts)
                    for k, (a, b) in enumerate(zip(ends - counts, ends)):
                        writer.add(doc_ids[first + k], np.concatenate((flat[a:b], end)))
                    seen[0] += last - first
                    seen[1] += len(flat) + last - first
            writer.close()

        path = f"{root}/part-{no:06d}.tokens"
        size = publish(path, fill)
        if seen[0]:
            yield pa.RecordBatch.from_pydict({"file_no": [no], "path": [path], "n_docs": [seen[0]], "n_tokens": [seen[1]], "bytes": [size]})

    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, "file_no long, path string, n_docs long, n_tokens long, bytes long")


def with_first(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``: ids in all files before. One row per file meets here."""
    return manifest.withColumn(
        "first", F.coalesce(F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    )


_ROW = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _emit(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_summaries(manifest: DataFrame) -> DataFrame:
    """Per document of the files of ``with_first(manifest)``: doc_id, start, n_tokens and ids_crc32, frame by frame."""
    import zlib

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in ((p, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            system, local = file_system(path)
            with system.open_input_file(local) as file:
                reader, rows = TokenFileReader(file, file.size()), []
                for k, doc_id in enumerate(reader.doc_ids):
                    crc = 0
                    for part in reader.parts(k):
                        crc = zlib.crc32(part.tobytes(), crc)
                    rows.append((doc_id, start, int(reader.counts[k]), crc))
                    start += int(reader.counts[k])
                    if len(rows) == 10_000:
                        yield from _emit(rows, schema)
                        rows = []
                yield from _emit(rows, schema)

    return _spread(manifest.select("path", "first")).mapInArrow(run, _ROW)


def read_documents(manifest: DataFrame, wanted: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents, a short list of ids; only the frames that hold them are unpacked."""
    wanted = frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, local = file_system(path)
            with system.open_input_file(local) as file:
                reader = TokenFileReader(file, file.size())
                for k, doc_id in enumerate(reader.doc_ids):
                    if doc_id in wanted:
                        ids = np.concatenate([*reader.parts(k), np.zeros(0, "<u4")]).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _spread(manifest.select("path")).mapInArrow(run, "doc_id long, ids array<long>")


def _spread(files: DataFrame) -> DataFrame:
    """One file's name per task as far as there are tasks."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "path")


def manifest_of(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Runs the write once and keeps its manifest beside the files."""
    from roadfuse.llm.shared import written

    return written(rows, "token-manifest")
