"""Quality classifier: hashed word and character n-gram vectors, averaged per document, and a softmax.

Features are single words, pairs of words and runs of CHARS bytes, hashed into BUCKETS; a pair that stood in
the text before counts once more, in a bucket that all such pairs share.  Training is
stochastic gradient descent in numpy, in one task, on at most SAMPLE labelled rows (whole texts); scoring
covers all rows.  As the average and the softmax's two classes are linear in the vectors, a trained
model comes down to one number per bucket, which is what scoring looks up.

Rows that are held out (see ``common.held_out``), rows without label and rows whose label is neither 0 nor 1 teach
nothing.  Only the text is looked at.  An empty or null text has no features and gets the score of the
bias alone; without any label all scores are 0.5.  Repeated rows are scored each, a null id stays null and isn't held
out, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column_named, held_out, in_arrow, kept_rows, steps, texts
from .words import BLANKS, U, byte_sums, grams, ragged, row_of, span_hash, spans

#: Bound of the labelled rows that training sees, taken in the order of a hash of the id.
SAMPLE = 6000
BUCKETS, SIZE, CHARS = 1 << 16, 8, 4
EPOCHS, ROWS_A_STEP, RATE = 6, 16, 50.0
#: The bucket of repeated pairs.
REPEATED = 0
#: Weight decay and width of the first random vectors.
DECAY, FIRST = 1e-6, 0.1


@dataclass(frozen=True)
class Model:
    """Log-odds of the good class: the mean of the features' weights, plus the bias."""

    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weight[features], dtype=np.float64)])
        n = np.diff(offsets)
        odds = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, text after text, and the texts' offsets."""
    start, end, first = spans(data, offsets, BLANKS)
    sums = byte_sums(data)
    words = span_hash(sums, start, end)
    pairs, pairs_first = grams(words, first, 2)
    size = np.diff(offsets)
    many = np.maximum(size - CHARS + 1, 0)
    runs_first = np.concatenate([[0], np.cumsum(many)])
    at = ragged(offsets[:-1], many)
    runs = span_hash(sums, at, at + CHARS)
    parts, firsts = (words, pairs, runs), (first, pairs_first, runs_first)
    row = row_of(pairs_first)
    order = np.lexsort((pairs, row))
    again = (pairs[order][1:] == pairs[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeats = np.bincount(row[order][1:][again], minlength=len(offsets) - 1)
    counts = np.stack([*(np.diff(f) for f in firsts), repeats], 1)
    where = np.cumsum(counts.ravel()).reshape(counts.shape)
    out = np.full(int(counts.sum()), REPEATED, np.int64)
    for k, part in enumerate(parts):
        out[ragged(where[:, k] - counts[:, k], counts[:, k])] = (part >> U(40)) % U(BUCKETS)
    return out, np.concatenate([[0], where[:, -1]])


def train(rows: list[tuple[np.ndarray, int]], seed: int = 1) -> Model:
    """Gradient descent on (features, label) rows, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    vectors, out, bias = rng.uniform(-FIRST, FIRST, (BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.zeros(2)
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    # A text's features once each, with their shares.
    packed = []
    for found, label in rows:
        buckets, n = np.unique(found, return_counts=True)
        packed.append((buckets, n / max(1, n.sum()), label))
    steps_, total = 0, EPOCHS * -(-len(rows) // ROWS_A_STEP)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), ROWS_A_STEP):
            some = [packed[i] for i in order[at:at + ROWS_A_STEP]]
            rate = RATE * (1 - steps_ / total)
            steps_ += 1
            size = np.array([len(b) for b, _, _ in some])
            buckets, share = np.concatenate([b for b, _, _ in some]), np.concatenate([s for _, s, _ in some])
            row = np.repeat(np.arange(len(some)), size)
            used = vectors[buckets] * share[:, None]
            mean = np.stack([np.bincount(row, used[:, d], len(some)) for d in range(SIZE)], 1)
            odds = mean @ out + bias
            p = np.exp(odds - odds.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), [label for _, _, label in some]] -= 1
            p /= len(some)
            back = (p @ out.T)[row] * share[:, None]
            bias -= 0.05 * rate * p.sum(0)
            out -= 0.05 * rate * (mean.T @ p + DECAY * out)
            for d in range(SIZE):
                vectors[:, d] -= rate * np.bincount(buckets, back[:, d], BUCKETS)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Train on labelled rows that aren't held out; of rows that share an id the one with the smallest text teaches."""
    known = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    taught = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` pairs of numbers

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            ids, marks = column_named(batch, "doc_id").to_pylist(), column_named(batch, "label").to_pylist()
            for a, b, data, offsets in steps(column_named(batch, "text")):
                found, cut = features(data, offsets)
                for i, x, y in zip(range(a, b), cut[:-1], cut[1:]):
                    held.setdefault(ids[i], (found[x:y].astype(np.uint16 if BUCKETS <= 1 << 16 else np.uint32), marks[i]))
        model = train([held[i] for i in sorted(held)])
        yield pa.RecordBatch.from_pydict({"weight": [model.weight.tobytes()], "bias": [model.bias]})

    found = in_arrow(rows.repartition(1).sortWithinPartitions("doc_id", "text"), learn, "weight binary, bias double").first()
    return Model(np.frombuffer(bytes(found["weight"]), np.float32), found["bias"]) if found else train([])


def _scores(batch: pa.RecordBatch, model: Model) -> np.ndarray:
    return np.concatenate([model.score(*features(data, offsets)) for _, _, data, offsets in steps(column_named(batch, "text"))])


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, where it is read."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([column_named(batch, "doc_id"), pa.array(_scores(batch, model))], names=["doc_id", "score"])
    scored = arrow_map(texts(docs), run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def likely_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents, all columns, with at least this score."""
    return kept_rows(docs, lambda batch: pa.array(_scores(batch, model) >= least))
