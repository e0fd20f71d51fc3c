"""Token ids in directly addressable codes.

Each id is split into chunks of 8 bits.  Level 0 holds the lowest chunk of every id, level j the next
chunk of those ids that go on; a bitmap per level tells which go on, and a rank directory over the
bitmap tells where.  So any id is found with one look per level, without decoding others.

File: segments one after the other, then a footer and its length.  A segment holds whole documents
(about a million ids; a longer document has its own):

    levels | documents | ids | ids per document, document ids, null flags | per level: length, chunks, bitmap, ranks

Counts and lengths are little-endian unsigned 64-bit numbers; ranks count the set bits before every 512th.
The footer holds (place, size, documents, ids) of each segment.

Documents stand in ascending order of id (null ids first, equal ids by text); a null text is empty; other
columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_named, in_arrow, shared_folder, steps, stored, texts
from .store import new_file, open_file
from .tokens import DEFAULT_VOCABULARY, STEP_BYTES, encoder

SEGMENT_IDS = 1 << 20
BITS, RANK_EVERY = 8, 512
_COUNT, _ENTRY = np.dtype("<u8"), 4
MANIFEST = "file_no long, path string, n_docs long, n_tokens long"


def _numbers(*values: int) -> bytes:
    return np.array(values, _COUNT).tobytes()


def pack_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, ranks) of each level."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(BITS) > 0
        ones = np.concatenate([[0], np.cumsum(more)])
        levels.append((rest.astype(np.uint8), np.packbits(more, bitorder="little"), ones[:-1:RANK_EVERY].astype(_COUNT)))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint64(BITS)


def segment_bytes(doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    levels = pack_levels(ids)
    parts = [_numbers(len(levels), len(sizes), len(ids)), sizes.astype(_COUNT).tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes()]
    for chunks, bitmap, ranks in levels:
        parts += [_numbers(len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Segment:
    """One segment; ``data`` is any object that slices to bytes."""

    def __init__(self, data):
        self.data = data
        n, self.n_docs, self.n_ids = np.frombuffer(data[:24], _COUNT).astype(int)
        at = 24 + 17 * self.n_docs
        self.levels = []
        for _ in range(n):
            size = int(np.frombuffer(data[at:at + 8], _COUNT)[0])
            chunks, bitmap = at + 8, at + 8 + size
            ranks = bitmap + (size + 7) // 8
            at = ranks + 8 * ((size + RANK_EVERY - 1) // RANK_EVERY)
            self.levels.append((size, chunks, bitmap, ranks))

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, null flags, sizes) of the documents."""
        a, n = 24, self.n_docs
        return (np.frombuffer(self.data[a + 8 * n:a + 16 * n], "<i8"), np.frombuffer(self.data[a + 16 * n:a + 17 * n], np.uint8) > 0,
                np.frombuffer(self.data[a:a + 8 * n], _COUNT).astype(np.int64))

    def token(self, i: int) -> int:
        """The id at place i, from one chunk, one bit and one rank block per level."""
        value = 0
        for k, (_, chunks, bitmap, ranks) in enumerate(self.levels):
            value |= self.data[chunks + i:chunks + i + 1][0] << (BITS * k)
            if not self.data[bitmap + i // 8:bitmap + i // 8 + 1][0] >> (i % 8) & 1:
                break
            block = i // RANK_EVERY
            before = self.data[bitmap + block * RANK_EVERY // 8:bitmap + i // 8 + 1]
            bits = int.from_bytes(before, "little") & ((1 << (i - block * RANK_EVERY)) - 1)
            i = int(np.frombuffer(self.data[ranks + 8 * block:ranks + 8 * block + 8], _COUNT)[0]) + bits.bit_count()
        return value

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = where = None
        for k, (size, chunks, bitmap, ranks) in enumerate(self.levels):
            chunk = np.frombuffer(self.data[chunks:bitmap], np.uint8).astype(np.uint32) << np.uint32(BITS * k)
            if k == 0:
                out, where = chunk, np.arange(size)
            else:
                out[where] |= chunk
            where = where[np.unpackbits(np.frombuffer(self.data[bitmap:ranks], np.uint8), count=size, bitorder="little") > 0]
        return out


class _Slices:
    """Byte ranges of a file, read when asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start = file, start

    def __getitem__(self, at: slice) -> bytes:
        return self.file.read_at(at.stop - (at.start or 0), self.start + (at.start or 0))


class DacFile:
    """Random access to a file: reads the footer, then only the bytes that an id needs."""

    def __init__(self, path: str):
        self.file = open_file(path)
        size = self.file.size()
        n = int(np.frombuffer(self.file.read_at(8, size - 8), _COUNT)[0])
        self.footer = np.frombuffer(self.file.read_at(n, size - 8 - n), _COUNT).astype(np.int64).reshape(-1, _ENTRY)
        self.first = np.concatenate([[0], np.cumsum(self.footer[:, 3])])
        self.segments: dict[int, Segment] = {}

    def token(self, i: int) -> int:
        if not 0 <= i < self.first[-1]:
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        if k not in self.segments:
            self.segments[k] = Segment(_Slices(self.file, int(self.footer[k, 0])))
        return self.segments[k].token(int(i - self.first[k]))


def _sorted_segments(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int) -> Iterator[tuple[bytes, int, int]]:
    held, many = [], 0
    for batch in batches:
        keys, column = column_named(batch, "doc_id"), column_named(batch, "text")
        for a, b, _, _ in steps(column, STEP_BYTES):
            ids, offsets = encoder(vocabulary).encode(column[a:b], end_id)
            nulls = np.array(keys[a:b].is_null())
            held.append((np.array(keys[a:b].fill_null(0)), nulls, np.diff(offsets), ids))
            many += len(ids)
            if many >= SEGMENT_IDS:
                parts = [np.concatenate(x) for x in zip(*held)]
                yield segment_bytes(*parts), len(parts[0]), many
                held, many = [], 0
    if held:
        parts = [np.concatenate(x) for x in zip(*held)]
        yield segment_bytes(*parts), len(parts[0]), many


def write_dac(docs: DataFrame, folder: str | None = None, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0) -> DataFrame:
    """Encode all texts, in ascending order of doc_id, into files of ``folder``; returns the stored manifest.

    Texts are range-partitioned on the id (one shuffle) and each partition is encoded and written as it
    streams by, a segment at a time.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "dac")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _sorted_segments(batches, vocabulary, end_id)
        head = next(segments, None)
        if head is None:
            return
        number = TaskContext.get().partitionId()
        path, footer, place = f"{folder}/part-{number:06d}.dac", [], 0
        with new_file(path) as out:
            while head is not None:
                data, n_docs, n_ids = head
                out.write(data)
                footer.append((place, len(data), n_docs, n_ids))
                place += len(data)
                head = next(segments, None)
            tail = np.array(footer, _COUNT).tobytes()
            out.write(tail + _numbers(len(tail)))
        yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [sum(f[2] for f in footer)], "n_tokens": [sum(f[3] for f in footer)]})

    ranged = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(in_arrow(ranged, write, MANIFEST), "dac-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with the ids before each file; one row per file, so one task holds them all."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("file_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit numbers, from the files, a segment at a time."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["file_start"]
                for place, size, _, _ in DacFile(row["path"]).footer:
                    with open_file(row["path"]) as file:
                        segment = Segment(file.read_at(int(size), int(place)))
                    keys, nulls, sizes = segment.documents()
                    ids = segment.all().astype("<u4").tobytes()
                    ends = np.cumsum(sizes)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(keys, pa.int64(), mask=nulls), pa.array(start + ends - sizes), pa.array(sizes),
                        pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(ids)])],
                        names=["doc_id", "start", "n_tokens", "ids"])
                    start += int(sizes.sum())
    files = with_starts(manifest).select("file_no", "path", "file_start").repartitionByRange(max(1, manifest.count()), "file_no")  # a task for each file
    return in_arrow(files, read, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(manifest: DataFrame, places: DataFrame) -> DataFrame:
    """(place, token) for asked places in the order of all ids; null or outside places give a null token.

    Places meet their file by a join on coarse blocks of places, then each is read by itself.
    """
    block = 1 << 22
    files = with_starts(manifest).withColumn("block", F.explode(F.sequence(F.floor(F.col("file_start") / block), F.floor((F.col("file_start") + F.col("n_tokens")) / block))))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("block", F.floor(F.col("place") / block))
    near = asked.join(files, "block", "left")
    inside = (F.col("place") >= F.col("file_start")) & (F.col("place") < F.col("file_start") + F.col("n_tokens"))
    hits = near.where(inside).select("place", "path", (F.col("place") - F.col("file_start")).alias("at"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, DacFile] = {}
        for batch in batches:
            rows = batch.to_pylist()
            for path in {r["path"] for r in rows} - files.keys():
                files[path] = DacFile(path)
            found = [files[r["path"]] for r in rows]
            yield pa.RecordBatch.from_arrays([column_named(batch, "place"), pa.array([f.token(r["at"]) for f, r in zip(found, rows)], pa.int64())], names=["place", "token"])
    found = in_arrow(hits, look, "place long, token long")
    missing = asked.select("place").join(hits.select("place"), "place", "left_anti").withColumn("token", F.lit(None).cast("long"))
    return found.unionByName(missing)
