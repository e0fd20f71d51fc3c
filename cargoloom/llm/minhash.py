"""Near-duplicate documents: one-permutation hashing with optimal densification, bands, stars of candidates.

Each shingle falls into one of the bins and leaves its hash there if it is the smallest.  An empty bin takes
the value of the first filled bin on its own random walk over all bins.  Bands of bins give bucket keys.
Within a bucket only the links to a centre are candidates (see ``stars``); they are confirmed on full shingle
sets.

Documents with equal shingle sets are one class from the start, so copies cost one row each.

A null text is empty; a text without words has no shingles and no links.  Rows with a null id take no part:
their component is null and they are kept.  Repeated rows each get a row.  Ids are meant to be unique: where
different texts share one, they are linked, and one of them stands for the id.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_named, in_arrow, steps, stored, texts
from .stars import star_components
from .words import BLANKS, LOWER, U, byte_sums, grams, mix, row_of, running, span_hash, spans

#: Bins a band and bands: a pair of similarity 0.8 shares no band about once in 200,000 cases.
ROWS, BANDS = 6, 40
_WALK = 1 << 12
#: Bits of the map that bounds what two sets can share.
BITS = 4096


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, in ascending order, and the row of each: runs of k words, or all words if fewer."""
    data = LOWER[data]
    start, end, first = spans(data, offsets, BLANKS)
    words = span_hash(byte_sums(data), start, end)
    runs, begin = grams(words, first, k)
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    whole = span_hash(running(words), first[short], first[short + 1])
    runs, rows = np.concatenate([runs, whole]), np.concatenate([row_of(begin), short])
    order = np.lexsort((runs, rows))
    runs, rows = runs[order], rows[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
    return runs[new], rows[new]


@cache
def _walks(bins: int) -> np.ndarray:
    """Bins that each bin looks at in turn."""
    n = np.arange(_WALK * bins, dtype=U) + U(1)
    return (mix(n * U(0xC2B2AE3D27D4EB4F)) % U(bins)).astype(np.int64).reshape(_WALK, bins)


def signatures(runs: np.ndarray, rows: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins) of smallest hashes, densified; rows without shingles hold the largest number."""
    empty = np.iinfo(U).max
    out = np.full(n * bins, empty, U)
    at = ((runs >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    np.minimum.at(out, rows * bins + at, mix(runs ^ U(0x2545F4914F6CDD1D)) >> U(1))
    out = out.reshape(n, bins)
    filled = out != empty
    doc, slot = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for walk in _walks(bins):
        if not len(doc):
            break
        look = walk[slot]
        hit = filled[doc, look]
        out[doc[hit], slot[hit]] = out[doc[hit], look[hit]]
        doc, slot = doc[~hit], slot[~hit]
    if len(doc):  # a walk that met no filled bin: the first one
        out[doc, slot] = out[doc, filled[doc].argmax(axis=1)]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A bucket key for each band, the band's number mixed in."""
    parts = signature.reshape(len(signature), -1, rows)
    key = np.broadcast_to(mix(np.arange(1, parts.shape[1] + 1, dtype=U)), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.astype(np.int64)


def _signed(docs: DataFrame, words: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, bits, keys): a and b are 128 bits that tell shingle sets apart, bits has one set for each shingle's hash."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in steps(column_named(batch, "text")):
                runs, row = shingles(data, offsets, words)
                n = hi - lo
                a, b = np.zeros(n, U), np.zeros(n, U)
                np.add.at(a, row, mix(runs + U(1)))
                np.add.at(b, row, mix(runs ^ U(0x9FB21C651E98DF25)))
                many = np.bincount(row, minlength=n)
                bits = np.zeros((n, BITS), bool)
                bits[row, (runs & U(BITS - 1)).astype(np.int64)] = True
                bits = np.packbits(bits, axis=1).view(np.int64)
                bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits.ravel()))
                keys = band_keys(signatures(runs, row, n, rows * bands), rows)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(many > 0, bands, 0))]).astype(np.int32)), pa.array(keys[many > 0].ravel()))
                yield pa.RecordBatch.from_arrays([column_named(batch, "doc_id")[lo:hi], pa.array(many.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), bits, keys],
                                                 names=["doc_id", "n_shingles", "a", "b", "bits", "keys"])
    return in_arrow(docs, sign, "doc_id long, n_shingles long, a long, b long, bits array<long>, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (c, v) whose full shingle sets are similar.  Both texts come by joins; a centre's many pairs are split over tasks."""
    side = lambda name: docs.select(F.col("doc_id").alias(name), F.col("text").alias(f"{name}_text"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, v = column_named(batch, "c"), column_named(batch, "v")
            again = np.array(c)[1:] == np.array(c)[:-1]  # a centre's rows stand together
            sets: list[np.ndarray] = []
            for a, b, data, offsets in steps(column_named(batch, "v_text")):
                runs, row = shingles(data, offsets, words)
                sets += np.split(runs, np.searchsorted(row, np.arange(1, b - a)))
            centre, keep = None, np.zeros(len(c), bool)
            for i, text in enumerate(column_named(batch, "c_text")):
                if i == 0 or not again[i - 1]:
                    raw = np.frombuffer(text.as_py().encode(), np.uint8)
                    centre = shingles(raw, np.array([0, len(raw)]), words)[0]
                keep[i] = similar(centre, sets[i], percent)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)), v.filter(pa.array(keep))], names=["c", "v"])
    return in_arrow(pairs.join(side("v"), "v").join(side("c"), "c").select("c", "v", "c_text", "v_text"), confirm, "c long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = texts(docs)
    signed = stored(_signed(docs, words, rows, bands), "signed")
    classes = signed.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    classes = stored(classes, "classes")
    same = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    heads = same.join(classes.select("a", "b", "rep"), (same["doc_id"] == classes["rep"]) & (same["a"] == classes["a"]) & (same["b"] == classes["b"])) \
        .select("rep", "n_shingles", "bits", "keys").dropDuplicates(["rep"])
    heads = stored(heads, "heads")
    entries = heads.select("rep", F.explode("keys").alias("key")).select("key", F.col("rep").alias("node"))
    facts = heads.select(F.col("rep").alias("node"), F.struct("n_shingles", "bits").alias("fact"))

    def may_link(one: Column, other: Column) -> Column:
        """A shingle whose bit the other set lacks isn't shared, which bounds the shared ones; sizes too far apart need no look at them."""
        n, m = one["n_shingles"], other["n_shingles"]
        lacking = F.aggregate(F.zip_with(one["bits"], other["bits"], lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda total, x: total + x)
        return (n * 100 >= m * percent) & (m * 100 >= n * percent) & ((n - lacking) * 100 >= (m + lacking) * percent)

    def prepare(nodes: DataFrame) -> Callable[[DataFrame], DataFrame]:
        involved = nodes.withColumnRenamed("node", "doc_id")
        bodies = stored(docs.join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "bodies")
        return lambda pairs: _confirmed(pairs, bodies, words, percent)

    labels = star_components(entries, facts, may_link, prepare)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "a", "b").join(named, ["a", "b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
