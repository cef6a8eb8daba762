"""WARC archives: a writer that refers back to equal payloads, and a splittable reader.

The writer makes one gzip member per record and one file per task (more if files
grow past ``archive_bytes``), in a folder all executors share. Every attempt of a
task writes files of its own names; the table of archives, which Spark commits once,
names those of the attempt that counts. Of records with equal payloads of at least
``min_bytes``, that with the largest id is a response and the others are revisits
that name it; they hold the HTTP headers only, with the full payload's length.

The reader deals byte ranges of the files to tasks. A task looks for the gzip magic
from the start of its range on, takes a hit for a member only if what it decodes
to starts as a WARC record, and from there reads member after member. It owns the
records that start inside its range, and reads past the end to finish the last.
Payload digests of responses are checked.

A null payload is an empty one; a null address is left out. A null id comes before
all others and is null again when read; revisits of a null id have null
``refers_to``. Rows that repeat the largest id of equal payloads are all responses.
An empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import keep, new_path

#: What a record has in common with all others.
DATE = "1970-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_BLOCK = 1 << 20
_STEP = 1 << 14


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, from a path or URI."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: int | None) -> str:
    return f"<urn:x-record:{'' if key is None else key}>"


def _key(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-record:").removesuffix(">")
    return int(number) if number else None


def record(key: int | None, uri: str | None, payload: bytes, revisits: bool, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisits else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {_urn(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    if revisits:
        head.append(f"WARC-Refers-To: {_urn(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(data) + gzip.flush()


def write_archives(
    df: DataFrame,
    id_column: str,
    uri_column: str,
    payload_column: str,
    min_bytes: int = 0,
    archive_bytes: int = 1 << 30,
) -> DataFrame:
    """Write a record for each row; (path, bytes, records) of the archives, already written.

    The payload is binary or text (written in UTF-8).
    """
    folder = new_path(df.sparkSession, "warc")
    pages = df.select(
        F.col(id_column).cast("long").alias("key"),
        F.col(uri_column).cast("string").alias("uri"),
        F.coalesce(F.col(payload_column).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("hash", F.sha1("payload"))
    equal = (
        pages.where(F.octet_length("payload") >= min_bytes)
        .groupBy("hash")
        .agg(F.count("*").alias("rows"), F.max("key").alias("kept"))
        .where("rows > 1")
        .select("hash", "kept", F.lit(True).alias("shared"))
    )
    records = pages.join(equal, "hash", "left").select(
        "key",
        "uri",
        "payload",
        F.expr("coalesce(shared and not (key <=> kept), false)").alias("revisits"),
        "kept",
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        out, done = None, []

        def close() -> None:
            out.close()
            final = f"part-{task:06d}-{len(done):04d}-{attempt}.warc.gz"
            store.move(own, f"{root}/{final}")
            done.append((f"{folder}/{final}", size, count))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    own = f"{root}/.writing-{attempt}-{len(done)}"
                    out, size, count = store.open_output_stream(own), 0, 0
                member = _member(
                    record(row["key"], row["uri"], row["payload"], row["revisits"], row["kept"])
                )
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d[0] for d in done], pa.string()),
                pa.array([d[1] for d in done], pa.int64()),
                pa.array([d[2] for d in done], pa.int64()),
            ],
            names=["path", "bytes", "records"],
        )

    return keep(records.mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Window:
    """A file read forward from a position, a block at a time."""

    def __init__(self, file, position: int):
        self.file, self.position = file, position
        self.data, self.base = b"", position  # the block that begins at base

    def has(self, position: int, count: int) -> bytes:
        """Up to ``count`` bytes at a position; b"" at the end. What is before may be let go."""
        if position < self.base:  # let go of already, for a member that proved to be none
            self.data, self.base = b"", position
        if position + count > self.base + len(self.data):
            self.data = self.data[position - self.base :]
            self.base = position
            while position + count > self.base + len(self.data):
                block = self.file.read_at(max(_BLOCK, count), self.base + len(self.data))
                if not block:
                    break
                self.data += block
        at = position - self.base
        return self.data[at : at + count]

    def find(self, end: int) -> int | None:
        """Where the next gzip magic starts, from the current position and before ``end``."""
        while self.position < end and len(self.has(self.position, len(_MAGIC))) == len(_MAGIC):
            at = self.data.find(_MAGIC, self.position - self.base)
            if at >= 0:
                return self.base + at if self.base + at < end else None
            # A magic may begin in the last bytes of this block.
            self.position = self.base + len(self.data) - len(_MAGIC) + 1
        return None


def _decode(window: _Window) -> tuple[bytes, int] | None:
    """Content and length of the WARC member at the window's position; None if there is none."""
    gzip, content, at = zlib.decompressobj(31), bytearray(), window.position
    while not gzip.eof:
        part = window.has(at, _STEP)
        try:
            content += gzip.decompress(part)
        except zlib.error:
            return None
        if not part or len(content) >= 6 and not content.startswith(b"WARC/1"):
            return None
        at += len(part) - len(gzip.unused_data)
    return (bytes(content), at - window.position) if content.startswith(b"WARC/1") else None


def members(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, content) of the members of a file that start in [start, end)."""
    window = _Window(file, start)
    while (at := window.find(end)) is not None:
        window.position = at
        found = _decode(window)
        if found:
            yield at, found[0]
        window.position = at + (found[1] if found else 1)


def parse(content: bytes) -> dict:
    """Fields of a record; the payload of responses is checked against its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = next(
        int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length:")
    )
    hashed = named["WARC-Payload-Digest"].removeprefix("sha1:")
    response = named["WARC-Type"] == "response"
    if response and digest(payload) != hashed:
        raise ValueError(f"payload of {named['WARC-Record-ID']} does not match its digest")
    return {
        "record_type": named["WARC-Type"],
        "key": _key(named["WARC-Record-ID"]),
        "uri": named.get("WARC-Target-URI"),
        "refers_to": None if response else _key(named["WARC-Refers-To"]),
        "payload_digest": hashed,
        "payload_bytes": len(payload) if response else declared,
        "payload": payload if response else None,
    }


_RECORD = pa.schema(
    [
        ("record_type", pa.string()),
        ("key", pa.int64()),
        ("uri", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def read_archives(archives: DataFrame, range_bytes: int = 64 << 20) -> DataFrame:
    """Records of the archives (path, bytes), read in ranges; ``payload`` is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                rows, size = [], 0
                with store.open_input_file(path) as file:
                    for _, content in members(file, row["start"], row["start"] + range_bytes):
                        rows.append(parse(content))
                        size += len(content)
                        if size >= 8 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    # Few rows, much work each: deal them out one by one rather than as they are stored.
    ranges = ranges.repartition("path", "start")
    return ranges.mapInArrow(
        read,
        "record_type string, key long, uri string, refers_to long, payload_digest string, "
        "payload_bytes long, payload binary",
    )
