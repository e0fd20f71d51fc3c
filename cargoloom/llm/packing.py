"""Best-fit packing of token pieces into sequences of a fixed capacity, with a bounded number of open bins.

Pieces arrive in the order of the partition.  The open bins are keyed by their free space in a bitset, so
the bin with the least room that suffices is the lowest set bit from the piece's length up.  If a new bin
is needed while the allowed number is open, the fullest one closes.  What is still open when a partition
ends is packed anew, by the same rule, in a few tasks that are sized by the tokens left over.

A null text is empty and gives one piece, the end id.  Null and repeated ids are packed like others, an
empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_named, in_arrow, steps, stored, texts
from .tokens import DEFAULT_VOCABULARY, STEP_BYTES, encoder

CAPACITY, OPEN_BINS = 1024, 256
#: Tokens that a task of the second round gets, in bins; its last open bins are the only ones that stay half empty.
SECOND_ROUND_BINS = 64 * OPEN_BINS
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, closed boolean"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: Sequence ids: round, partition and a count, in bits of a long.
_ROUND, _PARTITION = 62, 36


class OpenBins:
    """Online best fit with at most ``most`` open bins; closed bins come out as (number, members)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free_bits, self.by_free = 0, {}
        self.open, self.number = 0, 0

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.free_bits ^= 1 << free
        self.open -= 1
        return found

    def add(self, length: int, member) -> list[tuple[int, list]]:
        """Place a piece; returns the bins that close by it."""
        closed = []
        room = self.free_bits >> length << length
        if room:
            free = (room & -room).bit_length() - 1
            number, members = self._take(free)
        else:
            if self.open >= self.most:
                closed.append(self._take((self.free_bits & -self.free_bits).bit_length() - 1))
            free, number, members = self.capacity, self.number, []
            self.number += 1
        members.append((self.capacity - free, member))
        if free == length:
            closed.append((number, members))
        else:
            self.by_free.setdefault(free - length, []).append((number, members))
            self.free_bits |= 1 << (free - length)
            self.open += 1
        return closed

    def rest(self) -> list[tuple[int, list]]:
        return [found for stack in self.by_free.values() for found in stack]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, after a shorter first one if need be."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def _rows(closed: list[tuple[int, list]], base: int, whole: bool) -> pa.RecordBatch:
    rows = [(*member, base + number, offset, whole) for number, members in closed for offset, member in members]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_NAMES)


def _packed(pieces: Iterator[tuple], capacity: int, most: int, round_no: int, at_end: bool, at_once: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows of placed pieces; ``at_end``: whether bins that are open at the end count as closed."""
    base = (round_no << _ROUND) + (TaskContext.get().partitionId() << _PARTITION)
    bins, closed = OpenBins(capacity, most), []
    for member in pieces:
        closed += bins.add(member[3], member)
        if len(closed) >= at_once:
            yield _rows(closed, base, True)
            closed = []
    if closed:
        yield _rows(closed, base, True)
    rest = bins.rest()
    for k in range(0, len(rest), at_once):
        yield _rows(rest[k:k + at_once], base, at_end)


def token_pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, capacity: int) -> Iterator[tuple]:
    for batch in batches:
        keys, column = column_named(batch, "doc_id").to_pylist(), column_named(batch, "text")
        for a, b, _, _ in steps(column, STEP_BYTES):
            ids, offsets = encoder(vocabulary).encode(column[a:b], end_id)
            raw = ids.astype("<u4").tobytes()
            for key, begin, end in zip(keys[a:b], offsets[:-1].tolist(), offsets[1:].tolist()):
                for piece, (start, length) in enumerate(cut(end - begin, capacity)):
                    yield key, piece, start, length, raw[4 * (begin + start):4 * (begin + start + length)]


def best_fit_packing(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 2, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit) and its place, (sequence_id, offset).

    Texts are encoded where they are read and the placed pieces are written to the shared folder; only the
    pieces of bins left open are shuffled.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(token_pieces(batches, vocabulary, end_id, capacity), capacity, open_bins, 0, False)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (row for batch in batches for row in zip(*(column_named(batch, c).to_pylist() for c in _NAMES[:5])))
        return _packed(pieces, capacity, open_bins, 1, True)

    placed = stored(in_arrow(texts(docs), first, SCHEMA), "packed")
    left = placed.where(~F.col("closed"))
    tokens = left.agg(F.sum("length")).first()[0] or 0
    few = left.repartition(-(-tokens // (capacity * SECOND_ROUND_BINS)) or 1, F.xxhash64("doc_id", "piece", "ids")) \
        .sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids"), "doc_id", "piece", "ids")
    return placed.where("closed").unionByName(in_arrow(few, again, SCHEMA)).drop("closed")
