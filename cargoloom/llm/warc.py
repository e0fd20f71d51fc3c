"""WARC archives: a writer with revisit records and a sequential, verifying reader.

Each record is one gzip member.  The reader inflates a member bit by bit, frames the block by
Content-Length, and holds block and payload against their SHA-1 digests.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest page id is a
response and the others revisit it; shorter payloads are responses all.  A null html is an empty payload.
Rows that repeat the largest id are responses all; a row without id is never the one referred to while
an id is there.  A null url leaves out the target header.  Other columns are ignored; an empty table
gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, shared_folder, stored
from .store import new_file, open_stream

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which a new archive is begun, bytes that the reader takes at once, and bytes of a batch of records.
ARCHIVE_BYTES, READ_BYTES, BATCH_BYTES = 1 << 30, 1 << 16, 8 << 20
MANIFEST = "file_no long, path string, n_records long"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record, not compressed; a revisit if ``refers_to`` is given."""
    digest, revisit = base32_sha1(payload), refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": DATE,
        "WARC-Target-URI": url and "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url), "X-Page-Id": page_id,
        "WARC-Refers-To": _record_id(refers_to, digest) if revisit else None, "X-Refers-To-Page-Id": refers_to, "WARC-Profile": PROFILE if revisit else None,
        "WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _members(stream) -> Iterator[Iterator[bytes]]:
    """The inflated parts of each gzip member in turn."""
    held = b""

    def parts() -> Iterator[bytes]:
        nonlocal held
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            held = held or stream.read(READ_BYTES)
            if not held:
                raise ValueError("the archive ends within a record")
            out = inflate.decompress(held, READ_BYTES)
            held = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if out:
                yield out

    while held or (held := stream.read(READ_BYTES)):
        yield parts()


def _headers(text: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in text.decode().split("\r\n")[1:])}


def _until_blank(parts: Iterator[bytes], data: bytearray) -> bytes:
    """Take the lines up to an empty one off the front of ``data``, which grows as needed."""
    while (at := data.find(b"\r\n\r\n")) < 0:
        more = next(parts, None)
        if more is None:
            raise ValueError("a record without end of headers")
        data += more
    head = bytes(data[:at])
    del data[:at + 4]
    return head


def read_records(stream) -> Iterator[tuple]:
    """(page id, url, type, payload, payload bytes, digest, refers to) of each record, in turn; ValueError if one is damaged."""
    for parts in _members(stream):
        data = bytearray()
        head = _headers(_until_blank(parts, data))
        size = int(head["content-length"])
        for more in parts:
            data += more
            if len(data) > size + 4:
                break
        if len(data) != size + 4 or data[-4:] != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')}: the block has not the {size} bytes of its header")
        block = bytearray(data[:size])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if base32_sha1(block) != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"{head['warc-record-id']}: the block has another digest")
        http = _headers(_until_blank(iter(()), block))
        length, whole = int(http["content-length"]), head["warc-type"] == "response"
        if whole and (len(block) != length or base32_sha1(block) != digest):
            raise ValueError(f"{head['warc-record-id']}: the payload has another digest or length")
        number = lambda name: int(head[name]) if name in head else None
        yield number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], bytes(block) if whole else None, length, digest, number("x-refers-to-page-id")


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write an archive per partition and return the stored manifest.

    Equal payloads are found by SHA-256 on narrow rows with partial aggregation.  Pages meet their group
    by a plain join on the digest, whose large partitions Spark splits.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    body = F.coalesce(F.col("`html`"), F.lit("")).cast("binary")
    rows = pages.select(F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    groups = (rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"))
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    records = rows.join(groups, "digest", "left").select("page_id", "url", "payload", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            path, size, n = f"{folder}/part-{task:06d}-{number:05d}.warc.gz", 0, 0
            with new_file(path) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    record = record_bytes(*row)
                    out.write(member(record))
                    size, n, row = size + len(record), n + 1, next(rows, None)
            yield pa.RecordBatch.from_pydict({"file_no": [(task << 20) + number], "path": [path], "n_records": [n]})
            number += 1

    return stored(in_arrow(records, write, MANIFEST), "warc-manifest")


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of all archives, an archive per task; ``payloads=False`` leaves the payload column null."""
    def rows(path: str) -> Iterator[tuple]:
        with open_stream(path) as stream:
            for row in read_records(stream):
                yield row if payloads else (*row[:3], None, *row[4:])

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path in (p for batch in batches for p in batch.column(batch.schema.get_field_index("path")).to_pylist()):
            for row in rows(path):
                held.append(row)
                size += 500 + len(row[3] or b"")
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)

    files = manifest.select("file_no", "path").repartitionByRange(max(1, manifest.count()), "file_no")
    return in_arrow(files, read, RECORDS)
