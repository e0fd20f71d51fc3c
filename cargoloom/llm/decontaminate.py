"""Benchmark passages in documents, found by winnowing; DataFrame functions only.

A window is SPAN consecutive words of a benchmark item, or a whole shorter item.  For windows of n words the hashes of runs of
(n + 1) / 2 words are taken, and of each n words in a row the smallest one is kept.  Equal windows keep equal hashes,
so every window that occurs in a document shares a kept hash with it.  The kept hashes of both sides are joined; a
hit is extended to the windows of the document that kept the hash, and these are compared with the benchmark's
word by word.

Each document is read once.  Neighbouring windows that keep the same hash are one row, and only
rows whose hash the benchmark has go on.  Windows that stand in the same items are one class, and documents with the same classes are one
signature; items are listed once for each signature, so a passage that many items and many documents have
makes no pairs of both.

A null text has no words, and neither has an empty one: nothing is hit.  Very long texts are cut into pieces of PIECE words that
overlap by SPAN - 1, so memory follows the piece.  Each row of the documents is judged by itself, repeated ones too; a null
id stays null; other columns are ignored.  Benchmark rows that share an id are one item, a null item id is written as
the empty text, and an item without words has no window.  An empty table of documents gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

SPAN = 10
#: Words of a document that are looked at together.
PIECE = 1 << 16
#: The benchmark's hashes and windows are broadcast up to so many; beyond, they are joined by shuffles.
BROADCAST_WINDOWS = 200_000
#: What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), BETWEEN), lambda w: w != "")


def _upto(count: Column) -> Column:
    """0, 1, ... count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _with_windows(df: DataFrame, length: int) -> DataFrame:
    """``df`` with ``kept``: the smallest hash of a run of words in each window of ``length`` of its ``words``.

    Every step is a column of its own and used twice or as the argument of a function, so Spark computes it once a row.
    """
    run = (length + 1) // 2
    if run == 1:
        df = df.withColumn("runs", F.transform("words", lambda w: F.xxhash64(w)))
    else:
        df = df.withColumn("runs", F.transform(_upto(F.size("words") - run + 1), lambda i: F.xxhash64(*[F.get("words", i + d) for d in range(run)])))
    within = length - run + 1
    kept = F.col("runs") if within == 1 else F.transform(_upto(F.size("runs") - within + 1), lambda i: F.least(*[F.get("runs", i + d) for d in range(within)]))
    return df.withColumn("kept", kept)


def _joined(first: Column, count: Column) -> Column:
    """``count`` words from ``first`` on; by place, as ``slice`` walks through the whole array."""
    return F.array_join(F.transform(F.sequence(first, first + count - 1), lambda i: F.get("words", i)), " ")


def benchmark_windows(benchmark: DataFrame, span: int = SPAN) -> tuple[DataFrame, list[int]]:
    """(length, window, hash, item) of each window of each item, and the lengths that occur; a window is its words with blanks between, an item its id as text."""
    words = benchmark.select(F.coalesce(F.col("`item_id`").cast("string"), F.lit("")).alias("item"), words_in(F.coalesce(F.col("`text`"), F.lit(""))).alias("words"))
    # at most ``span`` lengths
    lengths = sorted(r["n"] for r in words.select(F.least(F.size("words"), F.lit(span)).alias("n")).where("n > 0").distinct().collect())
    parts = []
    for length in lengths or [span]:
        n = F.lit(length)
        # made where it is exploded: Spark filters on a plain array column first, with all that it is made of written out again
        each = F.transform(_upto(F.size("kept")), lambda at: F.struct(n.alias("length"), _joined(at, n).alias("window"), F.get("kept", at).alias("hash")))  # noqa: B023
        whole = F.size("words") >= span if length == span else F.size("words") == length
        parts.append(_with_windows(words.where(whole), length).select("item", F.inline(each)))
    return stored(reduce(DataFrame.unionByName, parts).distinct(), "windows"), lengths


def _extended(docs: DataFrame, lengths: list[int], span: int) -> DataFrame:
    """(row, doc_id, n_words, length, hash, first, words): the runs of windows that keep one hash, and a row of length 0 for each document."""
    rows = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("all", words_in(F.col("text"))) \
        .select("row", "doc_id", "all", F.size("all").alias("n_words"))
    starts = F.when(F.col("n_words") > 0, F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(PIECE))).otherwise(F.array(F.lit(0)))
    pieces = rows.withColumn("from", F.explode(starts)).select("row", "doc_id", "n_words", "from", F.slice("all", F.col("from") + 1, PIECE + span - 1).alias("words"))
    mark = F.struct(F.lit(0).alias("length"), F.xxhash64("row").alias("hash"), F.lit(0).alias("first"), F.lit("").alias("words"))
    own = F.filter(F.array(mark), lambda m: F.col("from") == 0)
    pieces, found = pieces.withColumn("own", own), [F.col("own")]
    for length in lengths:
        pieces = _with_windows(pieces, length)
        # a window that starts behind the piece is the next piece's
        pieces = pieces.withColumn("kept", F.slice("kept", 1, PIECE))
        pieces = pieces.withColumn("begin", F.filter(_upto(F.size("kept")), lambda i: (i == 0) | (F.get("kept", i) != F.get("kept", i - 1))))
        n = F.lit(length)
        run = lambda at, i: F.struct(
            n.alias("length"), F.get("kept", at).alias("hash"), (F.col("from") + at).alias("first"),
            _joined(at, F.coalesce(F.get("begin", i + 1), F.size("kept")) - at + n - 1).alias("words"))
        pieces = pieces.withColumn(f"found{length}", F.transform("begin", run)).drop("runs", "kept", "begin")
        found.append(F.col(f"found{length}"))
    return pieces.select("row", "doc_id", "n_words", F.inline(F.concat(*found)))


def _hit_words(spans: Column) -> Column:
    """Words in the union of spans (first, end), which are in order of their first word."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["first"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document, and as ``spans`` the windows that were found (first word, end)."""
    windows, lengths = benchmark_windows(benchmark, span)
    near = F.broadcast if windows.count() <= BROADCAST_WINDOWS else lambda df: df
    item_hash = lambda seed: F.bit_xor(F.xxhash64("item", F.lit(seed))).cast("string")
    classes = windows.groupBy("length", "window").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), item_hash(1), item_hash(2)).alias("class"))
    listed = windows.join(classes.groupBy("class").agg(F.min(F.struct("length", "window")).alias("one")).select("class", "one.length", "one.window"), ["length", "window"]).select("class", "item")

    marks = windows.select("length", "hash").distinct().withColumn("known", F.lit(True))
    hits = _extended(texts(docs), lengths, span).join(near(marks), ["length", "hash"], "left").where(F.col("known") | (F.col("length") == 0))
    split = F.split("words", " ")
    each = F.when(F.col("length") == 0, F.array(F.struct(F.col("first").alias("at"), F.col("row").cast("string").alias("window")))) \
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("split") - F.col("length")), lambda i: F.struct((F.col("first") + i).alias("at"), F.array_join(F.slice("split", i + 1, F.col("length")), " ").alias("window"))))
    spread = hits.withColumn("split", split).select("row", "doc_id", "n_words", "length", F.inline(each))
    true = spread.join(near(classes), ["length", "window"], "left").where(F.col("class").isNotNull() | (F.col("length") == 0))
    span_of = F.struct(F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("end"))
    judged = true.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
                                     F.array_sort(F.collect_list(F.when(F.col("length") > 0, span_of))).alias("spans"), F.array_sort(F.collect_set("class")).alias("classes"))
    judged = judged.withColumn("signature", F.when(F.size("classes") > 0, F.sha2(F.array_join("classes", ","), 256)))
    judged = stored(judged.select("doc_id", "n_words", "spans", "classes", "signature"), "judged")

    kinds = judged.where("signature IS NOT NULL").groupBy("signature").agg(F.first("classes").alias("classes"))
    items = kinds.select("signature", F.explode("classes").alias("class")).join(listed, "class").select("signature", "item").distinct()
    sums = items.groupBy("signature").agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    # a clean document has a key of its own in this join
    key = F.coalesce("signature", F.xxhash64("doc_id", "n_words").cast("string"))
    sums = sums.withColumnRenamed("signature", "__signature")
    return judged.join(sums, key == F.col("__signature"), "left").select(
        "doc_id", "n_words", _hit_words(F.col("spans")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")
