"""WARC files written from a page table and read back as a table of payload chunks.

Records of equal payloads are written once; the others are revisits that refer to it. The reader
streams each file: a payload of any size becomes rows of one record identifier and ascending chunk
numbers, each with the SHA-1 of all payload bytes so far. The writer sends slices of a page's bytes, as Arrow
holds them, through digest, compressor and file; neither side puts a whole record together.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadfuse.llm.shared import file_system, publish, written

#: Bytes of payload per row of the chunk table, and of a file read at once.
CHUNK_BYTES, _BLOCK = 1 << 18, 1 << 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"
CHUNKS = (
    "record_id string, page_id long, url string, record_type string, refers_to long, "
    "chunk_no int, data binary, payload_bytes long, payload_digest string, is_last boolean, refers_to_id string"
)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``original``: the page that holds the equal payload, null for responses.

    Payloads are the UTF-8 bytes of html, empty for null. Of equal payloads of ``least_bytes`` or
    more the one with the largest page_id is the response; rows of that same page_id all are. Where
    every page_id is null, all are responses.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_size"))
    # Copies are counted before the shuffle; stored, so that the join below meets two plain shuffles.
    copies = written(
        keyed.filter(F.col("_size") >= least_bytes)
        .groupBy("_sha1", "_size")
        .agg(F.max("page_id").alias("_top"), F.count("*").alias("_n"))
        .filter("_n > 1 and _top is not null")
        .drop("_n"),
        "warc-copies",
    )
    original = F.when(~F.col("page_id").eqNullSafe(F.col("_top")), F.col("_top"))
    return keyed.join(copies, ["_sha1", "_size"], "left").select("page_id", "url", "html", original.alias("original"))


def _urn(page_id: int | None) -> str:
    return f"<{_PAGE}{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    """The page of an identifier; None for those of other writers."""
    name = urn.strip().strip("<>")
    return int(name.removeprefix(_PAGE)) if re.fullmatch(_PAGE + "-?[0-9]+", name) else None


def _base32(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | memoryview, original: int | None, date: str) -> Iterator[bytes | memoryview]:
    """One record in parts, as a response with its payload or as a revisit without; the payload is cut, not copied."""
    slices = [payload[i : i + _BLOCK] for i in range(0, len(payload), _BLOCK)]
    sha1 = hashlib.sha1()
    for part in slices:
        sha1.update(part)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if original is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
        f"WARC-Payload-Digest: sha1:{_base32(sha1)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (len(payload) if original is None else 0)}",
    ]
    if original is not None:
        head += [f"WARC-Refers-To: {_urn(original)}", f"WARC-Profile: {_PROFILE}"]
    yield "\r\n".join(head).encode() + b"\r\n\r\n" + http
    if original is None:
        yield from slices
    yield b"\r\n\r\n"


def _bytes_of(text: pa.Scalar) -> bytes | memoryview:
    return memoryview(text.as_buffer()) if text.is_valid else b""


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes the records below the URI ``root``, each a gzip member, one file per task; returns path, n_records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0]

        def fill(stream) -> None:
            for batch in batches:
                for page_id, url, html, original in zip(*batch.columns):
                    pack = zlib.compressobj(level, wbits=31)
                    for part in record(page_id.as_py(), url.as_py(), _bytes_of(html), original.as_py(), date):
                        stream.write(pack.compress(part))
                    stream.write(pack.flush())
                    seen[0] += 1

        path = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = publish(path, fill)
        if seen[0]:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [seen[0]], "bytes": [size]})

    rows = with_revisits(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), least_bytes)
    return rows.mapInArrow(run, "path string, n_records long, bytes long")


class _Members:
    """Plain bytes of a file of gzip members, or of a file that isn't packed, block by block."""

    def __init__(self, file):
        self._file, self._held, self._unpack, self._packed = file, b"", None, None

    def _more(self) -> bool:
        if self._unpack is not None and self._unpack.unconsumed_tail:
            raw = self._unpack.unconsumed_tail
        elif self._unpack is not None and self._unpack.eof and self._unpack.unused_data:
            raw, self._unpack = self._unpack.unused_data, None
        else:
            raw = self._file.read(_BLOCK)
            if not raw:
                return False
        if self._packed is None:
            self._packed = raw[:2] == b"\x1f\x8b"
        if not self._packed:
            self._held += raw
            return True
        if self._unpack is None or self._unpack.eof:
            self._unpack = zlib.decompressobj(31)
        self._held += self._unpack.decompress(raw, _BLOCK)
        return True

    def whole_line(self, most: int | None = None) -> bytes | None:
        """The next line with its end, or its first ``most`` bytes; None at the end of the file."""
        while (at := self._held.find(b"\n", 0, most)) < 0 and (most is None or len(self._held) < most) and self._more():
            pass
        end = at + 1 if at >= 0 else len(self._held[:most])
        own, self._held = self._held[:end], self._held[end:]
        return own or None

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        own = self.whole_line()
        return None if own is None else own.rstrip(b"\r\n")

    def parts(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in blocks."""
        while size:
            if not self._held and not self._more():
                raise EOFError("the file ends inside a record")
            own, self._held = self._held[:size], self._held[size:]
            size -= len(own)
            if own:
                yield own


def _fields(members: _Members) -> dict[str, str]:
    out = {}
    while line := members.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _records(members: _Members, chunk_bytes: int) -> Iterator[dict]:
    while (line := members.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head = _fields(members)
        size, kind = int(head.get("content-length", 0)), head.get("warc-type", "")
        row = {
            "record_id": head.get("warc-record-id"), "page_id": None, "url": head.get("warc-target-uri"), "record_type": kind,
            "refers_to": _page(head.get("warc-refers-to", "")) if kind == "revisit" else None,
            "refers_to_id": head.get("warc-refers-to") if kind == "revisit" else None,
        }
        if kind not in ("response", "revisit"):
            for _ in members.parts(size):
                pass
            continue
        row["page_id"] = _page(head.get("warc-record-id", ""))
        length, http = 0, {}
        while length < size and head.get("content-type", "").startswith("application/http"):  # the HTTP header
            line = members.whole_line(size - length) or b""
            length += len(line)
            if not line.strip(b"\r\n"):
                break
            name, _, value = line.decode("latin-1").partition(":")
            http[name.strip().lower()] = value.strip()
        stated = head.get("warc-payload-digest", "")
        stated = stated.removeprefix("sha1:") if stated.startswith("sha1:") else ""
        if kind == "revisit":
            for _ in members.parts(size - length):
                pass
            yield row | {"chunk_no": 0, "data": b"", "payload_bytes": int(own) if (own := http.get("content-length", "")).isdecimal() else None, "payload_digest": stated or None, "is_last": True}
            continue
        sha1, done, left, no, held = hashlib.sha1(), 0, size - length, 0, b""
        for part in members.parts(left):
            held += part
            while len(held) >= chunk_bytes and done + chunk_bytes < left:
                sha1.update(held[:chunk_bytes])
                done += chunk_bytes
                yield row | {"chunk_no": no, "data": held[:chunk_bytes], "payload_bytes": done, "payload_digest": _base32(sha1), "is_last": False}
                held, no = held[chunk_bytes:], no + 1
        sha1.update(held)
        if stated and stated != _base32(sha1):
            raise ValueError(f"payload digest of {row['record_id']} is wrong")
        yield row | {"chunk_no": no, "data": held, "payload_bytes": done + len(held), "payload_digest": _base32(sha1), "is_last": True}


def read_chunks(files: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of the WARC files in column ``path``.

    Per chunk: record_id, page_id, url, record_type, refers_to, chunk_no from 0, data, and the
    bytes and digest (bare base32 SHA-1) of the payload up to its end. An empty payload has one
    empty chunk. A revisit has one empty chunk, with the size and digest that its header states.
    A response whose SHA-1 differs from its header is an error; digests of other kinds aren't compared. Archives of other
    writers are read alike: their records keep record_id and refers_to_id and have no page_id, a revisit that states no size
    or SHA-1 has null there, a response that isn't HTTP is payload from its first byte, and lines may end in LF alone.
    """
    schema = pa.schema(
        [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
         ("chunk_no", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("is_last", pa.bool_()),
         ("refers_to_id", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            system, local = file_system(path)
            with system.open_input_stream(local, compression=None) as file:
                rows, held = [], 0
                for row in _records(_Members(file), chunk_bytes):
                    rows.append(row)
                    held += len(row["data"]) + 200
                    if held >= 4 * chunk_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path").repartition(n, "path").mapInArrow(run, CHUNKS)
