"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding.

Spark's regular expression parts the texts into words.  Of each Arrow batch the distinct words are folded together, with
numpy: in a round, every word that still has a pair of tokens that make a token (its rank is its id) merges its lowest
pair, at all places from the left that don't overlap; then words take the ids of their distinct word.

Merging all places of a pair at once is the same as merging the leftmost lowest pair again and again if each token's own
bytes, folded that way, give the token: then a merge never makes a lower pair.  (Were x and the new token y a lower token's
bytes, nothing had been merged across their ends, so what lies between had been folded as by itself, to that
token.)  ``merge_table`` checks this; for ranks that fail, only the leftmost pair is merged in a round.

Nothing is shuffled and nothing kept between batches.  A very long text without a break is one word, folded rank by rank.  A null
text is empty: no tokens.  Repeated rows are encoded each, a null id stays null, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_named, in_arrow, texts, utf8
from .words import ragged, row_of

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: (?U): white space as Unicode has it.
PATTERN = "(?U)" + public_tokenizers.PATTERN
#: Words, and ids, that a step looks at; a text of more is a step of its own.
STEP_WORDS, STEP_IDS = 1 << 19, 1 << 19
#: Rank of a pair that makes no token.
_NONE = 1 << 40


@dataclass(frozen=True)
class MergeTable:
    """``keys``: pairs of tokens that make a token, as left * size + right, ascending; ``merged``: those tokens."""

    keys: np.ndarray
    merged: np.ndarray
    byte_ids: np.ndarray
    tokens: list[bytes]
    at_once: bool

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that two tokens make, _NONE if none."""
        if not len(self.keys):
            return np.full(len(left), _NONE)
        asked = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.merged[at], _NONE)

    def fold(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, offsets of the words) from the words' bytes."""
        ids, word = self.byte_ids[data], row_of(offsets)
        low = np.full(len(ids), _NONE)
        low[:-1] = np.where(word[:-1] == word[1:], self.pairs(ids[:-1], ids[1:]), _NONE)
        done_ids, done_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.repeat(np.minimum.reduceat(low, first), np.diff(first, append=len(ids)))
            ended = least == _NONE
            done_ids.append(ids[ended])
            done_words.append(word[ended])
            ids, word, low, least = (x[~ended] for x in (ids, word, low, least))
            at = np.flatnonzero(low == least)
            if not len(at):
                break
            if self.at_once:  # every other place of those that follow each other
                run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(run, append=len(at)))) % 2 == 0]
            else:
                at = at[np.diff(word[at], prepend=-1) != 0]
            ids[at] = low[at]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, word, low = ids[stays], word[stays], low[stays]
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(ids) - 1)
            same = (word[changed] == word[after]) & (changed < after)
            low[changed] = np.where(same, self.pairs(ids[changed], ids[after]), _NONE)
        ids, word = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(offsets) - 1))])


def _rank_table(ranks: dict[bytes, int]) -> MergeTable:
    size = max(ranks.values()) + 1
    found = [(left * size + right, rank) for token, rank in ranks.items() for cut in range(1, len(token))
             if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None]
    keys, merged = np.array(sorted(found), np.int64).reshape(-1, 2).T
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    own = sorted(ranks)
    careful = MergeTable(keys, merged, byte_ids, tokens, False)
    ids, offsets = careful.fold(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])]))
    whole = len(ids) == len(own) and ids.tolist() == [ranks[t] for t in own]
    return MergeTable(keys, merged, byte_ids, tokens, True) if whole else careful


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    with open(path, "rb") as file:
        return _rank_table({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)})


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens, offsets of the tokens)."""
    tokens = merge_table(path).tokens
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _row_steps(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of runs of whole rows of about ``most`` values."""
    row = 0
    while row < len(offsets) - 1:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, upto
        row = upto


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def encode(docs: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, ids) of every document, the ids as an array of integers.  Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = column_named(batch, "doc_id"), column_named(batch, "words")
            for a, b in _row_steps(np.array(rows.offsets), STEP_WORDS):
                many = np.concatenate([[0], np.cumsum(np.array(pc.list_value_length(rows[a:b])))])
                found = rows[a:b].flatten().dictionary_encode()
                ids, offsets = merge_table(ranks).fold(*utf8(found.dictionary))
                word = np.array(found.indices).astype(np.int64)
                sizes = np.diff(offsets)[word]
                ends = np.concatenate([[0], np.cumsum(sizes)])[many]
                ids = ids.astype(np.int32)[ragged(offsets[word], sizes)]
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])
    return in_arrow(texts(docs).select("doc_id", words_of(F.col("text")).alias("words")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """``encoded`` with the bytes of its ids joined, as ``decoded``; an unknown id has no bytes, null ids give null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, at = _token_bytes(ranks)
        for batch in batches:
            rows = column_named(batch, "ids")
            for a, b in _row_steps(np.array(rows.offsets), STEP_IDS):
                some = rows[a:b]
                many = np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(some), 0)))])
                ids = np.array(pc.fill_null(some.flatten(), -1)).astype(np.int64)
                ids = np.where((ids >= 0) & (ids < len(at) - 1), ids, len(at) - 1)  # a place behind all tokens, without bytes
                sizes = np.diff(at, append=at[-1])[ids]
                out = data[ragged(at[ids], sizes)]
                ends = np.concatenate([[0], np.cumsum(sizes)])[many].astype(np.int32)
                valid = pa.array(np.packbits(np.array(some.is_valid()), bitorder="little")).buffers()[1] if some.null_count else None
                decoded = pa.Array.from_buffers(pa.binary(), len(some), [valid, pa.py_buffer(ends), pa.py_buffer(out)])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, decoded], names=[*batch.schema.names, "decoded"])
    return in_arrow(encoded, run, encoded.withColumn("decoded", F.lit(None).cast("binary")).schema)
