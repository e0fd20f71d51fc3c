"""Quality rules by compression bands.

Zstandard ratios (compressed bytes / bytes) of the whole text and of fixed chunks of it are held
against limits that depend on length: a ratio below the band tells repetition, above it noise.  Noise in letters, digits
or base64 stays below these bands, so a closer upper limit, between clean and random texts of the length, is held as well.
Simple counts of words, symbols and repeats come along; two of them are hard limits.

A null text counts as empty.  Rows are judged one by one, so repeated rows get equal verdicts, a null
id stays null, and an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, column_named, kept_rows, steps, texts
from .words import BLANKS, byte_sums, grams, row_of, span_hash, spans

#: (bytes from, lowest, highest ratio of the whole text); shorter texts have no band, headers weigh too much there.
BANDS = ((256, 0.30, 0.95), (1024, 0.25, 0.85), (8192, 0.20, 0.80))
#: Chunks of so many bytes; a text of two chunks or more fails if over this share of them is outside the band.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 1024, (0.25, 0.90), 0.3
#: (bytes, highest ratio), straight between in the logarithm of the bytes: at each length above clean prose (from 1 KB also
#: above source and Markdown) and below random base64, letters with digits and bytes, in words and lines too.  A text of two chunks or more also fails if over
#: CHUNK_SHARE of them are above the limit of their size.
NOISE = ((256, 0.89), (512, 0.785), (1024, 0.73), (4096, 0.70), (8192, 0.68))
LEVEL = 3
#: Hard limits: words at least, and percent of words in repeated windows of so many words.
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "ratio double, odd_chunks double, reason string, kept boolean")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    cut = np.flatnonzero(data == 0x0A)
    start = np.concatenate([offsets[:-1], cut + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, cut, side="right") - 1])
    order = np.argsort(start * 2 + np.concatenate([np.zeros(len(offsets) - 1, int), np.ones(len(cut), int)]), kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    start, row = start[order], row[order]
    end = np.concatenate([start[1:] - 1, [len(data)]])
    last = np.concatenate([row[1:] != row[:-1], [True]])
    end[last] = offsets[row[last] + 1]
    filled = np.concatenate([[0], np.cumsum(~BLANKS[data])])
    worded = filled[end] > filled[start]
    start, end, row = start[worded], end[worded], row[worded]
    line = span_hash(sums, start, end)
    order = np.lexsort((line, row))
    again = np.zeros(len(order), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][again], minlength=len(offsets) - 1)


def _repeated_words(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Words that stand in a window of words found twice or more in their row."""
    runs, begin = grams(hashes, first, window)
    row = row_of(begin)
    order = np.lexsort((runs, row))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (runs[order][1:] == runs[order][:-1]) & (row[order][1:] == row[order][:-1])
    repeated = order[same[1:] | same[:-1]]
    at = repeated - begin[row[repeated]] + first[row[repeated]]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return _per_row(np.cumsum(cover[:-1]) > 0, first)


def band_reason(n: int, ratio: float, odd: float) -> str | None:
    """Why the compression bands refuse a text of n bytes; None if they don't."""
    band = next((b for b in reversed(BANDS) if n >= b[0]), None)
    if band and ratio < band[1]:
        return "repetitive"
    if band and ratio > band[2]:
        return "incompressible"
    return "odd chunks" if odd > CHUNK_SHARE else None


def noise_limit(n: int) -> float:
    """The highest ratio of a text of n bytes that isn't noise; shorter texts than the first have none."""
    return float(np.interp(np.log2(n), np.log2([b for b, _ in NOISE]), [r for _, r in NOISE])) if n >= NOISE[0][0] else np.inf


def noise_reason(n: int, ratio: float, sizes: list[float]) -> str | None:
    """Why a text of n bytes with these ratios of its chunks counts as noise; None if it doesn't."""
    if ratio > noise_limit(n):
        return "incompressible"
    return "odd chunks" if sum(s > noise_limit(CHUNK) for s in sizes) > CHUNK_SHARE * len(sizes) else None


def _sizes(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Ratio of the whole text, ratios of its whole chunks if it has two or more."""
    if not data:
        return 1.0, []
    whole = len(packer.compress(data)) / len(data)
    return whole, [len(packer.compress(data[i:i + CHUNK])) / CHUNK for i in range(0, len(data) - CHUNK + 1, CHUNK)] if len(data) >= 2 * CHUNK else []


def _odd(sizes: list[float]) -> float:
    """Share of chunks outside the chunk band."""
    return sum(not CHUNK_BAND[0] <= s <= CHUNK_BAND[1] for s in sizes) / len(sizes) if sizes else 0.0


def _ratios(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, share of its whole chunks outside the chunk band."""
    whole, sizes = _sizes(data, packer)
    return whole, _odd(sizes)


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    packer, parts = zstandard.ZstdCompressor(level=LEVEL), []
    for _, _, data, offsets in steps(column_named(batch, "text")):
        start, end, first = spans(data, offsets, BLANKS)
        sums = byte_sums(data)
        hashes = span_hash(sums, start, end)
        n_words = np.diff(first)
        chars = _per_row(~BLANKS[data] & ((data & 0xC0) != 0x80), offsets)
        repeat = _repeated_words(hashes, first, WINDOW)
        failed = (n_words < LEAST_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
        raw = data.tobytes()
        sizes = [_sizes(raw[a:b], packer) for a, b in zip(offsets[:-1], offsets[1:])]
        ratios = [(whole, _odd(some)) for whole, some in sizes]
        why = ["too short" if n < LEAST_WORDS else "repeated words" if bad else band_reason(int(size), *r) or noise_reason(int(size), *s)
               for n, bad, size, r, s in zip(n_words, failed, np.diff(offsets), ratios, sizes)]
        parts.append((n_words, chars, _per_row(_SYMBOL[data], offsets), _duplicate_lines(data, offsets, sums), repeat, failed,
                      np.array([r[0] for r in ratios]), np.array([r[1] for r in ratios]), np.array(why, object), np.array([w is None for w in why])))
    cols = [np.concatenate(c) for c in zip(*parts)]
    return pa.RecordBatch.from_arrays([column_named(batch, "doc_id"), *[pa.array(c.astype(np.int64)) for c in cols[:5]], pa.array(cols[5].astype(bool)),
                                       pa.array(cols[6]), pa.array(cols[7]), pa.array(cols[8], pa.string()), pa.array(cols[9].astype(bool))],
                                      names=[f.split()[0] for f in SCHEMA.split(", ")])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts, ratios, the verdict ``kept`` and the reason of a refusal.  No shuffle."""
    return arrow_map(texts(docs), _judge, SCHEMA)


def passing(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    return kept_rows(docs, lambda batch: column_named(_judge(batch), "kept"))
