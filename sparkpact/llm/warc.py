"""WARC: writes pages as records, one gzip member each, and reads archives back sequentially.

Reading inflates one member at a time from a stream, so memory is bounded by a chunk and a record; it frames the block
by content-length and holds the payload against its digest. Files are opened through pyarrow's file systems by URI,
and a task's files carry its attempt's name: only those that the manifest lists count, so a lost executor's tasks can
run again.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, shared_path, table

VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
#: Bytes after which a task begins its next archive.
ROLL = 1 << 28
_CHUNK = 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class Damaged(ValueError):
    """An archive breaks the format or a digest doesn't hold."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header."""
        return self.block.partition(b"\r\n\r\n")[2]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers), f"Content-Length: {len(block)}\r\n\r\n".encode()])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head + block + b"\r\n\r\n") + z.flush()


def records(stream, chunk: int = _CHUNK) -> Iterator[Record]:
    """The records of a stream, in order. Raises Damaged at a member, frame or digest that doesn't hold."""
    data, at = b"", 0
    while True:
        if not data and not (data := stream.read(chunk)):
            return
        z, out = zlib.decompressobj(31), io.BytesIO()
        begin = at
        while not z.eof:
            if not data and not (data := stream.read(chunk)):
                raise Damaged(f"the member at {begin} ends early")
            try:
                out.write(z.decompress(data))
            except zlib.error as e:
                raise Damaged(f"the member at {begin}: {e}") from None
            at += len(data) - len(z.unused_data)
            data = z.unused_data
        yield framed(out.getvalue(), begin)


def framed(raw: bytes, offset: int) -> Record:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise Damaged(f"no record header at {offset}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    try:
        size = int(headers["content-length"])
    except (KeyError, ValueError):
        raise Damaged(f"no content-length at {offset}") from None
    if rest[size:] != b"\r\n\r\n":
        raise Damaged(f"the block at {offset} isn't as long as its content-length")
    found = Record(headers, rest[:size], offset)
    if headers.get("warc-type") == "response" and f"sha1:{digest(found.payload)}" != headers.get("warc-payload-digest"):
        raise Damaged(f"the payload at {offset} doesn't have its digest")
    return found


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html with payload_digest, payload_bytes and refers_to (null: a response).

    Of equal payloads of at least `least` bytes the record with the largest page_id is the response. A null html is an
    empty payload; a null page_id refers to the largest if there is any; repeated rows of the largest are all responses.
    Digests are summed up per task before they are dealt out; a hot digest's rows are then split by the join.
    """
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(raw).alias("_sha"), F.octet_length(raw).cast("long").alias("payload_bytes"))
    best = p.where(F.col("payload_bytes") >= least).groupBy("_sha").agg(F.max("page_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return p.join(best, "_sha", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("_best")), F.col("_best"))).drop("_best", "_sha")


def _header(page_id, url, refers_to, payload: bytes) -> list[tuple[str, str]]:
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    target = "".join(c for c in url or "" if c > " ")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    return head if refers_to is None else [*head, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]


def write(pages: DataFrame, folder: str, roll: int = ROLL) -> DataFrame:
    """Writes archives of pages(page_id, url, html, refers_to) into `folder` and returns the manifest: path, n_records, bytes."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out = path = None
        n = size = 0

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_records", "bytes"])

        for b in batches:
            for page_id, url, html, ref in zip(*(b.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = os.path.join(base, f"part-{uuid.uuid4().hex}.warc.gz")
                    out, n, size = system.open_output_stream(path, compression=None), 0, 0
                payload = (html or "").encode()
                data = member(_header(page_id, url, ref, payload), _HTTP + payload if ref is None else _HTTP)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return cut(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records long, bytes long"))


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives, a task for each archive. A revisit's payload is null; without `payloads` all are."""

    def run(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in READ.split(", ")]
        ident = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in records(stream):
                        h, kind = r.headers, r.headers["warc-type"]
                        size = len(r.payload) if kind == "response" else int(h["x-payload-length"])
                        rows.append((ident(h["warc-record-id"]), h["warc-target-uri"], r.payload if payloads and kind == "response" else None, size, h["warc-payload-digest"].removeprefix("sha1:"), kind, ident(h.get("warc-refers-to")), r.offset))
                        held += len(r.block)
                        if len(rows) >= 5000 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spark = manifest.sparkSession
    return manifest.select("path").repartition(max(spark.sparkContext.defaultParallelism, 1)).mapInArrow(run, READ)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page through an archive and back: see `deduplicated`, `write` and `read`."""
    folder = shared_path(spark, "warc")
    manifest = write(deduplicated(table(spark, sf_dir, "pages")), folder)
    return read(manifest, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
     d AS (SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes, sha1(p.h) AS x, b.best
           FROM p JOIN b ON p.h = b.h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + CAST((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT)
                            >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""
