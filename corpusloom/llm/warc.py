"""WARC archives: written with one gzip member for each record, read back record by record.

The writer stores a payload once: of records with equal payloads the one of the largest id is the response, others are
revisits that refer to it. The reader is sequential: it decompresses incrementally (one zlib stream for each member), frames
records by Content-Length and verifies the digests, and holds a buffer and one record at a time.

Plan: payloads are compared by SHA-1 and length in one grouped aggregate, which is stored, so a payload that a third of all pages
share is one row of a table and a skewed side of a join of two scans, which adaptive execution splits. Each task writes archives of about
``ARCHIVE_BYTES`` to the shared folder, under another name until they are whole; the tasks' lists of archives are a table
there, from which the reading job is dealt out. Archives are opened by URI, so any store that pyarrow knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import scratch

ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 16
DATE = "2024-01-01T00:00:00Z"  # of every record, so that equal tables give equal archives
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6f2a3c58-3f0e-4d3b-9a0a-7b6d2f5a1c11")


class WarcError(ValueError):
    """An archive that is cut short, wrongly framed or does not match its digests."""


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(id))}>"


def record(id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the HTTP header with the payload's length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    uri = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "") or "about:blank"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        *([f"X-Page: {id}"] if id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of its own."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Members:
    """The decompressed bytes of a file of gzip members, read on demand; ``fresh`` is true at a member's start."""

    def __init__(self, source: BinaryIO, chunk: int = CHUNK) -> None:
        self.source, self.chunk = source, chunk
        self.packed, self.plain = b"", bytearray()
        self.z = None

    def more(self) -> bool:
        """Decompress a little more of the current member; false at its end."""
        if self.z is None or self.z.eof:
            return False
        if not self.packed:
            self.packed = self.source.read(self.chunk)
            if not self.packed:
                raise WarcError("the archive ends within a gzip member")
        try:
            self.plain += self.z.decompress(self.packed, self.chunk * 16)
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        self.packed = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def open(self) -> bool:
        """Begin the next member; false at the end of the file."""
        if self.plain:
            raise WarcError("bytes after a record's end")
        if not self.packed:
            self.packed = self.source.read(self.chunk)
        if not self.packed:
            return False
        self.z = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes, limit: int = 1 << 20) -> bytes:
        looked = 0
        while (at := self.plain.find(mark, looked)) < 0:
            looked = max(0, len(self.plain) - len(mark) + 1)
            if len(self.plain) > limit or not self.more():
                raise WarcError("a header has no end")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.more():
                raise WarcError("a record is shorter than its Content-Length")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def finish(self) -> None:
        while self.more():
            pass


def _fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def read(source: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], dict[str, str], bytes | None]]:
    """(WARC header, HTTP header, payload) of each record in turn, digests verified; the payload of a revisit is None."""
    members = _Members(source, chunk)
    while members.open():
        head = members.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise WarcError("a record does not begin with its version")
        warc = _fields(head)
        try:
            block = members.take(int(warc["content-length"]))
        except (KeyError, ValueError) as e:
            if isinstance(e, WarcError):
                raise
            raise WarcError("a record has no valid Content-Length") from e
        if members.take(4) != b"\r\n\r\n":
            raise WarcError("a record is longer than its Content-Length")
        members.finish()
        if "warc-block-digest" in warc and warc["warc-block-digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
            raise WarcError("a block does not match its digest")
        http_head, _, payload = block.partition(b"\r\n\r\n")
        http = _fields(http_head)
        if warc.get("warc-type") == "revisit":
            yield warc, http, None
            continue
        if "sha1:" + base32(hashlib.sha1(payload).digest()) != warc.get("warc-payload-digest") or str(len(payload)) != http.get("content-length"):
            raise WarcError("a payload does not match its digest or length")
        yield warc, http, payload


def planned(pages: DataFrame, url: str = "url", payload: str = "html", id: str = "page_id", least: int = 0) -> DataFrame:
    """``id``, url, payload (binary), digest (20 bytes) and refers_to, the largest ``id`` of those with an equal payload of at
    least ``least`` bytes, or null for that one itself and for smaller payloads. (Repeated rows of it are responses too; a
    null id comes before all others, and is never referred to.)"""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    largest = rows.select("digest", "n", "id").where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("id").alias("top"))
    # stored first: a join with an aggregate on its own key would keep the aggregate's partitions, which are not split
    out = rows.join(scratch.stored(largest, "payloads"), ["digest", "n"], "left")
    return out.select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, url: str = "url", payload: str = "html", id: str = "page_id", least: int = 0, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives under ``folder``, a URI, and returns the table (archive, records) that lists them, which is stored.

    An archive appears under its name only when it is whole. Each try of a task writes names of its own; those that the table
    does not list belong to a try that was lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        out, name, written, records = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{path}/{name}.part", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                key, uri, body, digest, refers = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(path, recursive=True)
                    name, written, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{path}/{name}.part", compression=None)
                data = member(record(key, uri, body, base32(digest), refers))
                out.write(data)
                written, records = written + len(data), records + 1
                if written >= size:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows = planned(pages, url, payload, id, least)
    return scratch.stored(rows.mapInArrow(run, "archive string, records long"), "archives")


def read_back(spark: SparkSession, archives: DataFrame, id: str = "page_id", kind: T.DataType | None = None) -> DataFrame:
    """``id``, payload_bytes, payload_digest (bare base32), record_type and refers_to of each record of the archives."""
    kind = kind or T.LongType()
    schema = T.StructType([T.StructField(id, kind), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = fs.FileSystem.from_uri(uri)
                seen, rows = 0, []
                with store.open_input_stream(path, compression=None) as source:
                    for warc, http, payload in read(source):
                        seen += 1
                        page, refers = warc.get("x-page"), warc.get("x-refers-to-page")
                        size = int(http["content-length"]) if payload is None else len(payload)
                        rows.append((page, size, warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"], refers))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                if seen != expected:
                    raise WarcError(f"{uri}: {seen} records; {expected} were written")
                yield _batch(rows)

    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in (id, "refers_to") else f for f in schema])
    names = text.names

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 1 else pa.string()) for k, c in enumerate(columns)], names=names)

    n = max(1, archives.count())
    records = archives.repartition(n, "archive").mapInArrow(run, text)
    return records.select(F.col(id).cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def round_trip(pages: DataFrame, url: str = "url", payload: str = "html", id: str = "page_id", least: int = 0) -> DataFrame:
    """What the archives of ``pages`` hold, written and read back: one row for each row of ``pages``, repeated ones too. A
    null payload is empty, a null url `about:blank`. An empty table gives an empty result."""
    spark = pages.sparkSession
    archives = write(pages, scratch.folder(spark, "warc"), url, payload, id, least)
    return read_back(spark, archives, id, pages.schema[id].dataType)
