"""WARC archives: one gzip member per record, written and read sequentially.

``write_archives`` marks repeated payloads (``revisit`` of the record with the
largest page_id among equal payloads), then every task streams its records
into archive files of about ``ARCHIVE_BYTES`` in a shared folder and returns
a manifest. File names carry the task attempt and the manifest is a table
committed by Spark, so a retried or speculative task leaves at most files that
no manifest names.

``read_archives`` deals the manifest's files out to tasks; each file is read
front to back with an incremental zlib decompressor in pieces of ``PIECE``
bytes, records are framed by Content-Length, and payload digests are checked.

Edge cases: a null html is an empty payload, a null url an empty target, a null
page_id is kept as null (and is smaller than any number); rows that repeat the
largest page_id of a payload are all responses; an empty table gives no
archive. Extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, read_table, scratch, stored

ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 16
LEVEL = 6
_END = b"\r\n\r\n"


class WarcError(ValueError):
    """A record that doesn't follow the format, or whose digest differs."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One uncompressed record; ``refers_to`` not None makes it a revisit, whose
    block keeps the HTTP header and leaves the payload out."""
    name = "" if page_id is None else str(page_id)
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    seed = f"{name}\n{url}\n{digest}\n{refers_to}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Page-Id: {name}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    """``data`` as one gzip member without a time stamp."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Uncompressed members of a stream, one after the other."""
    z, out, begun = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            begun = True
            out.append(z.decompress(piece))
            piece = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out, begun = zlib.decompressobj(31), [], False
    if begun:
        raise WarcError("the archive ends within a member")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(data: bytes) -> dict:
    """Fields, payload bytes and digest of one record; checks framing and digests."""
    head, found, rest = data.partition(_END)
    if not found or not head.startswith(b"WARC/"):
        raise WarcError("no record header")
    f = _fields(head)
    length = int(f["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != _END:
        raise WarcError("the block differs from its Content-Length")
    if f["warc-block-digest"] != "sha1:" + base32_sha1(block):
        raise WarcError("the block digest differs")
    http, found, payload = block.partition(_END)
    if not found:
        raise WarcError("no HTTP header")
    size, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
    if f["warc-type"] == "response":
        if len(payload) != size or base32_sha1(payload) != digest:
            raise WarcError("the payload differs from its length or digest")
    return {"page_id": int(f["x-page-id"]) if f["x-page-id"] else None, "url": f["warc-target-uri"], "payload_bytes": size,
            "payload_digest": digest, "record_type": f["warc-type"],
            "refers_to": int(f["x-refers-to-page"]) if "x-refers-to-page" in f else None,
            "payload": payload if f["warc-type"] == "response" else None}


def with_references(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null: a response). Payloads are equal
    if SHA-256 and length are; smaller ones than ``least`` bytes are never revisits.
    The large rows cross the network once; a payload that many pages share is a
    skewed key of a join against one row, which AQE splits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
    first = (pages.select("page_id", F.sha2(payload, 256).alias("key"), F.octet_length(payload).alias("size"))
             .where(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("kept")))
    return rows.join(first, "key", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per row of ``pages``; returns the committed manifest
    (path, records, bytes), one row per archive."""

    def write(batches):
        from pyspark import TaskContext
        import pandas as pd

        ctx = TaskContext.get()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        stem = f"{root}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        out, made, sink, n, size = [], 0, None, 0, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                payload = bytes(row.payload)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (row.page_id, row.refers_to))
                data = member(record(page_id, row.url or "", payload, base32_sha1(payload), refers_to))
                if sink is None:
                    path = f"{stem}-{made:05d}.warc.gz"
                    sink, n, size = fs.open_output_stream(path, compression=None), 0, 0
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    sink.close()
                    out.append((path, n, size))
                    sink, made = None, made + 1
        if sink is not None:
            sink.close()
            out.append((path, n, size))
        yield pd.DataFrame(out, columns=["path", "records", "bytes"])

    rows = with_references(pages, least).select(F.col("page_id").cast("long").cast("string").alias("page_id"), "url", "payload",
                                                F.col("refers_to").cast("long").cast("string").alias("refers_to"))
    return stored(rows.mapInPandas(write, "path string, records long, bytes long"), "warc-manifest")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


#: Archive bytes of a reading task, once there are more than the tasks that can run at once.
READ_BYTES = 128 << 20


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the manifest's archives, with the payload (binary,
    null for revisits) if ``payloads``."""
    columns = [x.split()[0] for x in _READ.split(", ")] + ["payload"] * payloads

    def read(batches):
        import pandas as pd

        fs, _ = filesystem(folder)
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in members(_pieces(stream)):
                        rows.append(parse(data))
                        held += len(rows[-1]["payload"] or b"") * payloads + 200
                        if held >= 4 << 20:
                            yield _frame(pd, rows, columns)
                            rows, held = [], 0
                yield _frame(pd, rows, columns)

    count, size = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    # a number of its own, which isn't coalesced: a path is a small row, what it names isn't
    parallel = manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("path").repartition(max(1, min(count, max(parallel, -(-size // READ_BYTES)))))
    return files.mapInPandas(read, _READ + ", payload binary" * payloads)


def _frame(pd, rows, columns):
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([r[c] for r in rows], dtype="Int64")
    return out


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLE = {"op9_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> ((3 - i % 4) * 5)::BIGINT)::INT % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM d"""}
