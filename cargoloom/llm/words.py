"""Words and rolling hashes of whole columns of UTF-8 text with numpy.

All separators are single ASCII bytes, so bytes can be told apart without decoding.  A word's hash
comes from differences of one running polynomial sum, so the cost is a few vector operations a byte.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Word rules: for each byte, whether it parts words.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z, all other bytes as they are.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        step = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, base, U)]))
        return step(_BASE), step(pow(_BASE, -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least of the base and of its inverse modulo 2^64."""
    return _powers(max(20, int(n).bit_length()))


def running(values: np.ndarray) -> np.ndarray:
    """Sums of value * base^place before each place; ``span_hash`` takes hashes of spans from them."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, U), np.cumsum(values * powers(len(values))[0][:len(values)])])


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal spans have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U) * U(0xA0761D6478BD642F))


def byte_sums(data: np.ndarray) -> np.ndarray:
    return running(_BYTE[data])


def spans(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the count of all): words don't cross rows."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~parts[data]
    left = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    right = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~left | edge[:-1]))
    end = np.flatnonzero(inside & (~right | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the rows' first runs."""
    n = np.diff(first)
    many = np.maximum(n - k + 1, 0)
    begin = np.concatenate([[0], np.cumsum(many)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], many)
    return span_hash(running(hashes), at, at + k), begin


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)
