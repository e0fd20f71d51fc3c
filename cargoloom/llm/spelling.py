"""Words that differ by one code point, found by search schemes in bidirectional FM-indexes of the vocabulary.

The vocabulary is cut into shards of neighbouring words, once in its order and once in the order of the words
spelled backwards.  A word and one that differs from it by one insertion, deletion or replacement agree in the word's first half
or in its last, so a word is asked in the shards that hold its first half and, backwards, in those that hold its last.  Each shard is
a bidirectional index: suffix ranks of its delimited words and of the same text backwards, with intervals that are kept
together.  A search matches the half exactly, from its inner end to the delimiter, then turns round and extends over the other half
with one error allowed, to the delimiter there.  What both searches find is counted in the first.

A shard holds about SHARD words; a shard that is asked by more than ASKED words is given to several tasks, each with a
part of them, so a half that much of the vocabulary has does not make one long task.  Each task sends one row per word that it was asked: how many near words there are,
and the most frequent.  Words whose form is taken further follow by doubling.

A null text has no words and neither has an empty one; a null id counts as the empty text; rows that share an id are texts of their own;
repeated rows count as often as they stand; other columns are ignored; long texts are read whole; an empty table gives no rows.  Ties of the count go to the smaller word in code-point order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column_named, in_arrow, stored
from .words import ragged

#: Fewest code points of a word, fewest occurrences, and every how many-th occurrence loses a code point.
LEAST, OFTEN, LOSES = 7, 2, 31
#: A word's form has so many times its occurrences.
TIMES = 10
#: Words of a shard, words that a task is asked, words that are searched together, code points of a border between shards.
SHARD, ASKED, BLOCK, BORDER = 50_000, 200_000, 4_096, 64
RUN = r"[A-Za-zÀ-ÿ]{%d,}"


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN, loses: int = LOSES) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased; where the checksum of id and run says so, without one code point."""
    runs = docs.select(F.coalesce(F.col("`doc_id`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(F.coalesce(F.col("`text`"), F.lit("")), F.lit(RUN % least), F.lit(0))).alias("run"))
    lower = runs.select("id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("run"))
    sums = lower.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    words = sums.select(F.when(F.col("h") % loses == 0, without).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


class _Ranks:
    """Suffix ranks of a cyclic text: the symbol before each suffix, and a step from an interval to that with a symbol in front."""

    EVERY = 64

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = len(text)
        bits = max(1, int(symbols - 1).bit_length())
        wide = 62 // bits
        key = np.zeros(n, np.int64)
        for d in range(wide):
            key = (key << bits) | np.roll(text, -d)
        reach = wide
        while True:
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            if rank[order[-1]] == n - 1 or reach >= n:
                break
            key = rank * n + np.roll(rank, -reach)
            reach *= 2
        self.n, self.suffix, self.before = n, order, text[order - 1]
        by_symbol = np.argsort(self.before, kind="stable")
        self._steps = self.before[by_symbol] * (n + 1) + by_symbol
        blocks = -(-n // self.EVERY)
        count = np.zeros((blocks + 1, symbols + 1), np.int32)
        np.add.at(count, (np.arange(n) // self.EVERY + 1, self.before + 1), 1)
        self._less = np.cumsum(np.cumsum(count, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        self._padded = np.concatenate([self.before, np.full(self.EVERY, symbols, self.before.dtype)])

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where an interval border goes when ``symbol`` is put in front."""
        return np.searchsorted(self._steps, symbol * (self.n + 1) + at)

    def less(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many suffixes of an interval have a smaller symbol before them."""
        def upto(at: np.ndarray) -> np.ndarray:
            block = at // self.EVERY
            inside = self._padded[(block * self.EVERY)[:, None] + np.arange(self.EVERY)]
            in_block = (inside < symbol[:, None]) & (np.arange(self.EVERY) < (at - block * self.EVERY)[:, None])
            return self._less[block, symbol] + in_block.sum(axis=1)
        return upto(hi) - upto(lo)


class Index:
    """Both directions of a delimited vocabulary."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        text = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self._alphabet, codes = np.unique(text, return_inverse=True)
        codes = codes.astype(np.int64)
        self.onward, self.backward = _Ranks(codes, len(self._alphabet)), _Ranks(codes[::-1].copy(), len(self._alphabet))
        self._word_before = np.cumsum(codes == 0) - 2  # of a delimiter

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' symbols, -1 for those that no word here has, and the words' borders."""
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.minimum(np.searchsorted(self._alphabet, text), len(self._alphabet) - 1)
        return np.where(self._alphabet[place] == text, place, -1), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    def _halves(self, text: np.ndarray, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals, in the backward ranks, of a delimiter and the first halves: matched from the inner end outwards."""
        n = len(start)
        lo, hi, other = np.zeros(n, np.int64), np.full(n, self.onward.n), np.zeros(n, np.int64)
        for done in range(int(half.max()) + 1):
            live = np.flatnonzero((hi > lo) & (done <= half))
            place = half[live] - 1 - done
            symbol = np.where(place >= 0, text[start[live] + np.maximum(place, 0)], 0)
            hi[live[symbol < 0]] = 0
            live, symbol = live[symbol >= 0], symbol[symbol >= 0]
            if not len(live):
                break
            a, b = lo[live], hi[live]
            other[live] += self.onward.less(symbol, a, b)
            lo[live], hi[live] = self.onward.step(symbol, a), self.onward.step(symbol, b)
        return other, other + np.maximum(hi - lo, 0)

    def near(self, words: list[str], half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked word, number of a word here) of all pairs that agree in the first half and have one error behind it."""
        text, border = self.codes(words)
        start, length = border[:-1], np.diff(border)
        ranks = self.backward
        lo, hi = self._halves(text, start, half)
        who, at = np.flatnonzero(hi > lo), half[hi > lo]
        lo, hi = lo[who], hi[who]
        tried: list[tuple[np.ndarray, ...]] = []
        while len(who):
            more = at < length[who]
            ahead = np.where(more, text[np.minimum(start[who] + at, len(text) - 1)], 0)
            after = np.where(at + 1 < length[who], text[np.minimum(start[who] + at + 1, len(text) - 1)], -2)
            # every symbol that follows in an interval, each interval looked through once
            spots, which = np.unique(lo * (ranks.n + 1) + hi, return_inverse=True)
            a, b = spots // (ranks.n + 1), spots % (ranks.n + 1)
            follows = np.unique(np.repeat(np.arange(len(spots)), b - a) * len(self._alphabet) + ranks.before[ragged(a, b - a)])
            spot, symbol = follows // len(self._alphabet), follows % len(self._alphabet)
            spot, symbol = spot[symbol > 0], symbol[symbol > 0]
            first = np.searchsorted(spot, np.arange(len(spots) + 1))
            new_lo, new_hi = ranks.step(symbol, a[spot]), ranks.step(symbol, b[spot])
            many = np.diff(first)[which]
            state, pick = np.repeat(np.arange(len(who)), many), ragged(first[:-1][which], many)
            other = symbol[pick] != ahead[state]
            state, pick = state[other], pick[other]
            tried.append((who[state], at[state], new_lo[pick], new_hi[pick]))  # one more code point than asked
            swap = more[state]
            tried.append((who[state[swap]], at[state[swap]] + 1, new_lo[pick[swap]], new_hi[pick[swap]]))  # another one
            skip = more & (ahead != after)
            tried.append((who[skip], at[skip] + 1, lo[skip], hi[skip]))  # one less
            keep = more & (ahead > 0)
            who, at, ahead, lo, hi = who[keep], at[keep] + 1, ahead[keep], lo[keep], hi[keep]
            lo, hi = ranks.step(ahead, lo), ranks.step(ahead, hi)
            live = hi > lo
            who, at, lo, hi = who[live], at[live], lo[live], hi[live]
        if not tried:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who, at, lo, hi = (np.concatenate(c) for c in zip(*tried))
        asked, found = [], []
        while len(who):
            ends = at == length[who]
            symbol = np.where(ends, 0, text[np.minimum(start[who] + at, len(text) - 1)])
            known = symbol >= 0
            who, at, ends, symbol = who[known], at[known], ends[known], symbol[known]
            lo, hi = ranks.step(symbol, lo[known]), ranks.step(symbol, hi[known])
            live = hi > lo
            asked.append(who[live & ends])
            found.append(self._word_before[ranks.n - 1 - ranks.suffix[lo[live & ends]]])
            live &= ~ends
            who, at, lo, hi = who[live], at[live] + 1, lo[live], hi[live]
        pairs = np.unique(np.concatenate(asked) * len(self.words) + np.concatenate(found))
        return pairs // len(self.words), pairs % len(self.words)


def _borders(spelled: DataFrame, many: int) -> list[str]:
    """Upper ends of ``many`` ranges of the words; a short text for each range."""
    tops = spelled.repartitionByRange(many, "spelled").groupBy(F.spark_partition_id()).agg(F.max(F.substring("spelled", 1, BORDER)).alias("top"))
    return sorted({r["top"] for r in tops.collect()})


def _routed(words: DataFrame, borders: list[list[str]]) -> DataFrame:
    """(shard, asks, word, n): each word where it is kept, and where it is asked, in order and backwards (odd shards)."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [])
        for word, n in zip(column_named(batch, "word").to_pylist(), column_named(batch, "n").to_pylist()):
            for side, half in ((0, len(word) // 2), (1, len(word) - len(word) // 2)):
                spelled = word[::-1] if side else word
                for shard, asks in [(bisect_left(borders[side], spelled), False),
                                    *((s, True) for s in range(bisect_left(borders[side], spelled[:half]), bisect_left(borders[side], spelled[:half] + "\U0010FFFF") + 1))]:
                    for column, value in zip(out, (2 * shard + side, asks, spelled, n)):
                        column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["shard", "asks", "word", "n"])
    return arrow_map(words, run, "shard int, asks boolean, word string, n long")


def _answers(side: int, kept: list[tuple], index: Index, asked: list[str]) -> Iterator[tuple]:
    """(word, near words, occurrences of the most frequent one, that one) of each asked word that has any."""
    half = np.array([len(w) - len(w) // 2 if side else len(w) // 2 for w in asked], np.int64)
    who, found = index.near(asked, half)
    spelled = [w[::-1] for w, _ in kept] if side else [w for w, _ in kept]
    if side:  # those that agree in the first half as well are found there
        only = np.array([not spelled[f].startswith(asked[w][::-1][:len(asked[w]) // 2]) for w, f in zip(who, found)], bool)
        who, found = who[only], found[only]
    if not len(who):
        return
    n = np.array([n for _, n in kept], np.int64)[found]
    place = np.empty(len(kept), np.int64)
    place[np.argsort(np.array(spelled, object), kind="stable")] = np.arange(len(kept))
    order = np.lexsort((place[found], -n, who))
    who, found, n = who[order], found[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    for i, many in zip(first, np.diff(np.concatenate([first, [len(who)]]))):
        word = asked[who[i]]
        yield word[::-1] if side else word, int(many), int(n[i]), spelled[found[i]]


ANSWER = "word string, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard and part, the kept words first."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column_named(batch, c).to_pylist() for c in ("shard", "part", "asks", "word", "n")))

    def out(answers: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*answers), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[f.split()[0] for f in ANSWER.split(", ")])

    for (shard, _), some in groupby(rows(), lambda r: r[:2]):
        kept, asked, index = [], [], None
        for _, _, asks, word, n in some:
            if not asks:
                kept.append((word, n))
                continue
            if not kept:
                break  # a half that no word of this shard can have
            index = index or Index([w for w, _ in kept])
            asked.append(word)
            if len(asked) >= BLOCK:
                if answers := list(_answers(shard % 2, kept, index, asked)):
                    yield out(answers)
                asked = []
        if asked and (answers := list(_answers(shard % 2, kept, index, asked))):
            yield out(answers)


def near_words(words: DataFrame, shard: int = SHARD, most: int = ASKED) -> DataFrame:
    """(word, n_near, best_n, best) of each word that has near ones: their number and the most frequent; ``words`` are distinct (word, n)."""
    spark = words.sparkSession
    many = max(-(-words.count() // shard), int(spark.conf.get("spark.sql.shuffle.partitions")))
    borders = [_borders(words.select(spelled.alias("spelled")), many) for spelled in (F.col("word"), F.reverse("word"))]
    routed = _routed(words, borders)
    # a row for each shard
    parts = stored(routed.where("asks").groupBy(F.col("shard").alias("at")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")), "parts")
    spread = routed.join(parts, F.col("shard") == F.col("at")).withColumn(
        "part", F.explode(F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    grouped = spread.select("shard", "part", "asks", "word", "n").repartition("shard", "part").sortWithinPartitions("shard", "part", "asks", "word")
    found = in_arrow(grouped, _search, ANSWER)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b"))
    return best.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): twice as far in each round; a form has more occurrences than its word, so there are no rings."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("__at"), F.col("root").alias("__on"))
        moved = stored(reached.join(ahead, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("moved")), "roots")
        reached = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the vocabulary."""
    words = stored(vocabulary(docs), "vocabulary")
    near = near_words(words)
    takes = F.col("best_n") >= times * F.col("n")
    judged = stored(words.join(near.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n")), "near")
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots.withColumnRenamed("word", "__word"), F.col("word") == F.col("__word"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
