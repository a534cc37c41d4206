"""WARC archives written and read as a table of chunks.

A payload of any size travels as rows (record, chunk number, bytes): the writer compresses and the reader inflates
chunk by chunk, with a running length and a running SHA-256 in every row, so no whole record is held. Records with
equal payloads of at least ``LEAST_REVISIT`` bytes are stored once: that of the smallest page_id is a response, the
others are revisits that refer to it.

Every task writes archives of its own with names no other attempt uses, and reports them in a manifest that
Spark commits; archives of lost or repeated attempts are in no manifest and are never read. Each archive is read by
one task, and archives are closed at about ``ARCHIVE_BYTES``.

A null payload is empty. A null url or page_id leaves its header out. Repeated rows give a record each; those of the
smallest page_id are all responses. No pages give no archives. Line breaks in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbrook.llm.common import materialize, rows_of
from silverbrook.session import scratch_path

LEAST_REVISIT = 100
CHUNK = 1 << 18  # characters when writing, bytes when reading
ARCHIVE_BYTES = 256 << 20
_RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def plan_records(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``pages`` (page_id, url, payload) with bytes, digest, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce(F.col(payload), F.lit("")).alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    same = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("digest").alias("key"), "first")
    # Small payloads get a key each that matches nothing, so they do not meet in one task.
    key = F.when(F.col("bytes") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat(
        F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("key", key).join(same, "key", "left")
    again = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    return joined.select(
        "page_id", "url", "payload", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias(
            "record_type"), F.when(again, F.col("first")).alias("refers_to"))


def chunks_to_write(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a response's payload, in order; one row without bytes for a revisit."""
    last = F.when(F.col("record_type") == "revisit", 0).otherwise(
        F.greatest(F.lit(0), F.floor((F.length("payload") - 1) / chunk)))
    rows = records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    part = F.encode(F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)), "UTF-8")
    return rows.select("page_id", "url", "bytes", "digest", "record_type", "refers_to", "chunk_no",
                       F.when(F.col("record_type") == "response", part).alias("data"))


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_RECORDS, f'page:{page_id}/{digest}')}>"


def header(page_id, url, size: int, digest: str, kind: str, refers_to) -> bytes:
    """The WARC header and the HTTP head of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": size,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(http) + (size if kind == "response" else 0),
    }
    if page_id is not None:
        fields["X-Page-ID"] = page_id
    if url is not None:
        fields["WARC-Target-URI"] = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
    if kind == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(refers_to, digest)
        fields["X-Refers-To-Page-ID"] = refers_to
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class Archive:
    """One open archive: every record is a gzip member of its own."""

    def __init__(self, files: FileSystem, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.stream, self.records, self.bytes, self.member = files.open_output_stream(self.path, compression=None), 0, 0, None

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.bytes += len(data)

    def begin(self, head: bytes) -> None:
        self.end()
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.records += 1
        self.put(self.member.compress(head))

    def add(self, data: bytes) -> None:
        self.put(self.member.compress(data))

    def end(self) -> None:
        if self.member:
            self.put(self.member.compress(b"\r\n\r\n") + self.member.flush())
            self.member = None

    def close(self) -> tuple[str, int, int]:
        self.end()
        self.stream.close()
        return self.path, self.records, self.bytes


def write_archives(records: DataFrame, folder: str | None = None, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records below ``folder`` (any store pyarrow can open) and returns the manifest (path, records, bytes)."""
    spark = records.sparkSession
    folder = re.sub(r"^file:/+", "/", folder or scratch_path(spark, "warc"))
    files, place = FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)

    def write(batches):
        files, place = FileSystem.from_uri(folder)
        archive, done = None, []
        names = ("page_id", "url", "bytes", "digest", "record_type", "refers_to", "chunk_no", "data")
        for page_id, url, size, digest, kind, refers_to, number, data in rows_of(batches, *names):
            if number == 0:
                if archive and archive.bytes >= limit:
                    done.append(archive.close())
                    archive = None
                archive = archive or Archive(files, place)
                archive.begin(header(page_id, url, size, digest, kind, refers_to))
            if data:
                archive.add(data)
        if archive:
            done.append(archive.close())
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)],
            ["path", "records", "bytes"])

    manifest = chunks_to_write(records).mapInArrow(write, "path string, records long, bytes long")
    return materialize(manifest, "warc-manifest").withColumn("folder", F.lit(folder))


@dataclass
class Inflater:
    """Lines and bytes of a gzip stream of many members, a bounded buffer at a time."""

    stream: object
    step: int = 1 << 16
    buffer: bytearray = field(default_factory=bytearray)
    packed: bytes = b""
    member: object = None

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.stream.read(self.step)
                if not self.packed:
                    return False
            self.member = self.member or zlib.decompressobj(31)
            data = self.member.decompress(self.packed, self.step)
            self.packed = self.member.unconsumed_tail
            if self.member.eof:
                self.packed, self.member = self.member.unused_data, None
            if data:
                self.buffer += data
                return True

    def line(self) -> bytes | None:
        """The next line without its CRLF; None at the end."""
        while (at := self.buffer.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[:at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def read_chunks(stream, chunk: int = CHUNK) -> Iterator[tuple]:
    """(ordinal, headers, chunk number, last, length so far, SHA-256 so far, bytes) for every chunk of an archive."""
    source, ordinal = Inflater(stream), 0
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        headers = {}
        while line := source.line():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        left = int(headers["content-length"])
        while line := source.line():  # the HTTP head
            left -= len(line) + 2
        left -= 2
        running, total, number = hashlib.sha256(), 0, 0
        while True:
            data = source.take(min(chunk, left))
            left -= len(data)
            total += len(data)
            running.update(data)
            yield ordinal, headers, number, left == 0, total, running.hexdigest(), data
            number += 1
            if not left:
                break
        ordinal += 1


def read_archives(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a manifest.

    ``total_bytes`` and ``sha256`` run up to and including the row's chunk; in the row marked ``last`` they are those
    of the payload. A revisit has one empty chunk and tells length and digest of the payload in ``payload_bytes`` and
    ``payload_digest``. A payload that does not agree with its header is an error.
    """
    kinds = {"path": pa.string(), "ordinal": pa.int64(), "record_id": pa.string(), "page_id": pa.int64(),
             "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(),
             "payload_digest": pa.string(), "chunk_no": pa.int32(), "last": pa.bool_(), "total_bytes": pa.int64(),
             "sha256": pa.string(), "data": pa.binary()}

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    def read(batches):
        rows, held = [], 0
        number = lambda text: None if text is None else int(text)
        for folder, path in rows_of(batches, "folder", "path"):
            files, _ = FileSystem.from_uri(folder)
            with files.open_input_stream(path, compression=None) as stream:
                for ordinal, h, at, last, total, digest, data in read_chunks(stream, chunk):
                    size, named = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha256:")
                    if last and h["warc-type"] == "response" and (total, digest) != (size, named):
                        raise ValueError(f"damaged record {h['warc-record-id']} in {path}")
                    rows.append((path, ordinal, h["warc-record-id"], number(h.get("x-page-id")), h["warc-type"],
                                 number(h.get("x-refers-to-page-id")), size, named, at, last, total, digest,
                                 data if with_data else None))
                    held += len(data) if with_data else 0
                    if len(rows) >= 2_000 or held >= 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        yield batch_of(rows)

    schema = ("path string, ordinal long, record_id string, page_id long, record_type string, refers_to long, "
              "payload_bytes long, payload_digest string, chunk_no int, last boolean, total_bytes long, sha256 string, "
              "data binary")
    spread = manifest.select("folder", "path").repartition(max(1, manifest.count()))
    return spread.mapInArrow(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read from archives written for the purpose."""
    manifest = write_archives(plan_records(pages))
    ends = read_archives(manifest, with_data=False).where("last")
    own = F.col("record_type") == "response"
    return ends.select(
        "page_id", F.when(own, F.col("total_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("sha256")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
