"""Document fingerprints by winnowing.

Hashes of all runs of K code points; of each window of WINDOW consecutive runs the smallest is kept, the
rightmost of equal ones, with its position.  Two texts that share WINDOW + K - 1 code points in a row share a
kept hash; what is shorter than K leaves none beyond the text's own.  A text shorter than a run has one hash of
its whole, one with fewer runs than a window has the smallest, an empty text has none.

The likeness of two fingerprints is the Jaccard index of their hashes; two empty ones are alike (1).  A null text
is empty, repeated rows are fingerprinted each, a null id stays null, an empty table gives no rows, other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, column_named, in_arrow, steps, texts
from .words import U, mix, running, span_hash

K, WINDOW = 16, 32
_LOW = U(0xFFFFFFFF)


def fingerprints(batch: list[str], k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, offsets of the texts): kept hashes in the order of the text."""
    raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in batch]
    n = np.array([len(r) for r in raw], np.int64)
    begin = np.concatenate([[0], np.cumsum(n)])
    sums = running(mix(np.concatenate([np.zeros(0, np.uint32), *raw]).astype(U) + U(1)))
    size = np.minimum(n, k)
    runs = np.where(n > 0, n - size + 1, 0)
    first = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(batch)), runs)
    place = np.arange(first[-1]) - first[row]
    at = begin[row] + place
    # The smallest hash and, of equal ones, the last place: one number to compare.
    keys = (span_hash(sums, at, at + size[row]) & (_LOW << U(32))) | (_LOW - place.astype(U))
    if not len(keys):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(batch) + 1, np.int64)
    least, reach = keys.copy(), 1
    while reach < window:
        step = min(reach, window - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    few = np.flatnonzero((runs > 0) & (runs <= window))
    if len(few):
        ends = np.stack([first[few], first[few + 1]], 1).ravel()
        least[first[few]] = np.minimum.reduceat(np.concatenate([keys, keys[-1:]]), ends)[::2]
    kept = place < np.maximum(runs - window + 1, 1)[row]
    kept[1:] &= ~kept[:-1] | (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    keys, row = least[kept], row[kept]
    return (keys >> U(32)).astype(np.uint32), (_LOW - (keys & _LOW)).astype(np.int64), np.searchsorted(row, np.arange(len(batch) + 1))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def winnow(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, hashes, positions) of every document, where it is read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = column_named(batch, "doc_id"), column_named(batch, "text")
            for a, b, _, _ in steps(column):
                some = [t or "" for t in column[a:b].to_pylist()]
                hashes, places, offsets = fingerprints(some, k, window)
                cut = pa.array(offsets.astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array([len(t) for t in some], pa.int64()), pa.ListArray.from_arrays(cut, pa.array(hashes.astype(np.int64))),
                                                  pa.ListArray.from_arrays(cut, pa.array(places))], names=["doc_id", "n_chars", "hashes", "positions"])
    return in_arrow(texts(docs), run, "doc_id long, n_chars long, hashes array<long>, positions array<long>")


def block_of(key: Column, tops: list[int]) -> Column:
    """Which block a key is in, by halving: block j holds the keys up to tops[j] and above tops[j + 1]; null is in the last."""
    # The largest j with tops[j] >= key; tops descend.
    table = F.lit(tops)
    def halve(found: Column, step: Column) -> Column:
        look = found + step.cast("int")
        return F.when((look < len(tops)) & (F.get(table, look) >= F.coalesce(key, F.lit(tops[-1]))), look).otherwise(found)
    powers = [1 << j for j in reversed(range(max(1, len(tops) - 1).bit_length()))]
    return F.aggregate(F.lit(powers), F.lit(0), halve)


def with_next(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text, ahead): the documents in blocks of descending id, and behind each block, marked ``ahead``, the one that follows.

    The tops of the blocks come from a range partitioning of the ids alone; there is a number of them per
    shuffle partition, whatever the rows.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").repartitionByRange(many, F.desc("doc_id"))
    tops = sorted((r["top"] for r in ids.groupBy(F.spark_partition_id()).agg(F.max("doc_id").alias("top")).collect()), reverse=True)
    if not tops:
        rows = docs.select(F.lit(0).alias("block"), "doc_id", "text", F.lit(False).alias("ahead"))
        return rows.repartitionByRange(many, "block").sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), "text")
    heads = docs.where(F.col("doc_id").isin(tops)).groupBy("doc_id").agg(F.min("text").alias("text"))
    last = len(tops) - 1
    before = F.when(block_of(F.col("doc_id"), tops) == 0, last).otherwise(block_of(F.col("doc_id"), tops) - 1)
    rows = docs.select(block_of(F.col("doc_id"), tops).alias("block"), "doc_id", "text", F.lit(False).alias("ahead")) \
        .unionByName(heads.select(before.alias("block"), "doc_id", "text", F.lit(True).alias("ahead")))
    return rows.repartitionByRange(many, "block").sortWithinPartitions("block", "ahead", F.desc_nulls_last("doc_id"), "text")


def _with_following(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text, next text) of rows sorted by block; a block without a row ahead goes round to its first."""
    first = held = None
    for batch in batches:
        for block, doc_id, text, ahead in zip(*(column_named(batch, c).to_pylist() for c in ("block", "doc_id", "text", "ahead"))):
            if held is not None:
                yield held[1], held[2], text if held[0] == block else first
            if held is None or held[0] != block:
                first = text
            held = None if ahead else (block, doc_id, text)
    if held is not None:
        yield held[1], held[2], first


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third replaced by the head of the next text in descending id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in _with_following(batches):
            held.append(row)
            size += len(row[1])
            if size >= STEP_BYTES // 2:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        ids, own, following = zip(*held)
        cut = [len(t) // 3 for t in own]
        edited = [t[:len(t) - n] + after[:n] for t, after, n in zip(own, following, cut)]
        where, extra = [], []
        for i, after in enumerate(following):  # most often the next row's text
            follows = i + 1 < len(own) and own[i + 1] is after
            where.append(i + 1 if follows else len(own) + len(extra))
            if not follows:
                extra.append(after)
        split = lambda found: [found[0][a:b] for a, b in zip(found[2][:-1], found[2][1:])]
        prints, edits = split(fingerprints([*own, *extra], k, window)), split(fingerprints(edited, k, window))
        text = lambda hashes: hashes.astype(">u4").tobytes().hex()
        out = [ids, [len(t) for t in own], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [text(p) for p in prints[:len(own)]], [text(p) for p in edits],
               [likeness(a, b) for a, b in zip(prints, edits)], [likeness(p, prints[j]) for p, j in zip(prints, where)]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[f.split()[0] for f in EDITED.split(", ")])
    return in_arrow(with_next(texts(docs)), run, EDITED)
