"""Prefix trie of conversations, totals passed from the leaves to the root by time-forward processing.

Each conversation is a sequence of turn digests.  Equal sequences are one row, and the rows are sorted as
lists, so all that share a prefix stand together; ranges of that order are the shards.  A shard's nodes are written out
from neighbouring rows, sorted by falling depth (Spark's sort spills), and read once: a node takes the messages that
its children have sent it from a priority queue, adds itself and sends its totals to its parent.  The queue holds at most
QUEUE messages; beyond, they are written as sorted runs to the shared folder and merged.

Only the nodes on the path that the last row of one shard shares with the first row of the next can have
descendants in several shards, at most a path for each border.  They are left open in their shards, their parts are
added up, and the tree that they form (the shards' roots) goes through the same processing in the end.

What stands in one task: the digests of one conversation (32 characters a turn, one row), the turns of one shard, and the shared paths.
Members that end in one node are joined to pieces of text in range order first, so the task that hashes a very common sequence
reads pieces and not members.

A turn without role or text counts with the empty text; turns are in order of their number, those without number first, then by
digest, so repeated turns all count and their order is settled.  Rows without conversation id are left out, as they can't be rebuilt.
Other columns are ignored.  Very long texts are hashed where they are read.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, shared_folder, stored
from .store import located, new_file, open_stream

#: A conversation takes up to HEADS - 1 turns of the first of its block of BLOCK ids.
BLOCK, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Messages that a task keeps in memory, rows of one output batch, characters of one piece of joined ids.
QUEUE, ROWS, PIECE = 200_000, 8_192, 1 << 18
ROOT = hashlib.md5(b"").hexdigest()
NODE = "shard int, depth int, node string, parent string, words int, ends_sha256 string, open boolean, n_convs long, conv_id long, n_children long, n_leaves long, saved_tokens long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _tuples(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, digests, words) of each conversation: the first turns of its block's first one, then its own from there on."""
    role, text = F.coalesce(F.col("`role`"), F.lit("")), F.coalesce(F.col("`text`"), F.lit(""))
    turn = F.struct(F.col("`turn`").isNotNull().alias("numbered"), F.coalesce(F.col("`turn`"), F.lit(0)).alias("turn"),
                    F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    narrow = conversations.where("`conv_id` IS NOT NULL").select(F.col("`conv_id`").cast("long").alias("conv_id"), turn.alias("turn"))
    own = stored(narrow.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("own")), "turns")
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("__base"), F.slice("own", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % BLOCK == F.col("__base"), "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0))
    turns = both.select("conv_id", F.concat(head, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))
    return turns.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))


def _ends(sequences: DataFrame) -> DataFrame:
    """(node, ends_sha256): the hash of the ids that end in each node, in order."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        node, first, held, size = None, None, [], 0
        for at, conv in _tuples(batches, "node", "conv_id"):
            if held and (at != node or size >= PIECE):
                yield node, first, ",".join(held)
                held, size = [], 0
            if not held:
                node, first = at, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if held:
            yield node, first, ",".join(held)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        node, so_far = None, None
        for at, text in _tuples(batches, "node", "ids"):
            if at != node:
                if so_far:
                    yield node, so_far.hexdigest()
                node, so_far = at, hashlib.sha256(text.encode())
            else:
                so_far.update(f",{text}".encode())
        if so_far:
            yield node, so_far.hexdigest()

    ranged = sequences.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = in_arrow(ranged, lambda b: _batches(pieces(b), "node string, first long, ids string"), "node string, first long, ids string")
    return in_arrow(joined.repartition("node").sortWithinPartitions("node", "first"), lambda b: _batches(hashes(b), "node string, ends_sha256 string"), "node string, ends_sha256 string")


def _shared(a: Column, b: Column) -> Column:
    """Turns that two sequences have in common at their start; -1 if there aren't two."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    apart = F.array_position(same, F.lit(False)).cast("int")
    return F.when(a.isNull() | b.isNull(), -1).when(apart == 0, F.size(a)).otherwise(apart - 1)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The nodes of each shard from its sorted sequences; a node is given out when the rows have left it."""
    shard, path, before, after = None, [], [], -1

    def row(depth: int, opened: bool) -> tuple:
        _, node, words, sha, n, conv, first = path[depth]
        return shard, depth, node, path[depth - 1][1] if depth else None, words, sha, opened or first, n, conv, 0, 0, 0

    def leave(upto: int, shares: int = -1) -> Iterator[tuple]:
        while len(path) > upto:
            yield row(len(path) - 1, len(path) - 1 <= shares)
            path.pop()

    for at, digests, words, sha, n, conv, first, last in _tuples(batches, "shard", "digests", "words", "ends_sha256", "n", "conv_id", "before", "after"):
        if at != shard:
            yield from leave(0, after)
            shard, before, after = at, first, last
            path.append(["", ROOT, 0, None, 0, None, before >= 0])
            begins = True
        else:
            begins = False
        depth = 0
        while depth < len(digests) and depth + 1 < len(path) and path[depth + 1][0] == digests[depth]:
            depth += 1
        yield from leave(depth + 1)
        for d in range(depth, len(digests)):
            path.append([digests[d], hashlib.md5((path[d][1] + digests[d]).encode()).hexdigest(), words[d], None, 0, None, begins and d + 1 <= before])
        path[-1][3:6] = sha, n, conv
    yield from leave(0, after)


class MessageQueue:
    """Messages (level, node, totals ...) in order; beyond ``most`` they are kept as sorted runs in ``folder``."""

    FIELDS = "level int, node string, n_convs long, conv_id long, n_leaves long, saved_tokens long"

    def __init__(self, folder: str, most: int) -> None:
        self.folder, self.most, self.here, self.heads, self.runs = folder, most, [], [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.here, message)
        if len(self.here) >= self.most:
            self._spill()

    def _spill(self) -> None:
        uri = f"{self.folder}/{hashlib.md5(repr((id(self), len(self.runs), self.here[0])).encode()).hexdigest()}"
        self.here.sort()
        with new_file(uri) as out:
            batches = _batches(iter(self.here), self.FIELDS)
            first = next(batches)
            with pa.ipc.new_stream(out, first.schema) as writer:
                writer.write(first)
                for batch in batches:
                    writer.write(batch)
        self.here = []
        self.runs.append(uri)
        self._next(len(self.runs) - 1, self._read(uri))

    @staticmethod
    def _read(uri: str) -> Iterator[tuple]:
        with open_stream(uri) as source, pa.ipc.open_stream(source) as reader:
            yield from _tuples(reader, *(f.split()[0] for f in MessageQueue.FIELDS.split(", ")))

    def _next(self, number: int, rows: Iterator[tuple]) -> None:
        if (head := next(rows, None)) is not None:
            heapq.heappush(self.heads, (head, number, rows))

    def take(self, level: int, node: str) -> Iterator[tuple]:
        """The messages to a node, which is the first one that has any."""
        while self.here and self.here[0][:2] == (level, node):
            yield heapq.heappop(self.here)
        while self.heads and self.heads[0][0][:2] == (level, node):
            head, number, rows = heapq.heappop(self.heads)
            yield head
            self._next(number, rows)

    def close(self) -> None:
        for uri in self.runs:
            system, path = located(uri)
            system.delete_file(path)
        self.runs = []


def _totals(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[tuple]:
    """Nodes sorted by shard and falling depth, with the totals of their subtrees; an open node gets those of its closed children only."""
    at, queue = None, None
    for shard, depth, node, parent, words, sha, opened, n, conv, children, leaves, saved in _tuples(batches, *(f.split()[0] for f in NODE.split(", "))):
        if shard != at:
            if queue:
                queue.close()
            at, queue = shard, MessageQueue(folder, most)
        for _, _, more, least, ends, gain in queue.take(-depth, node):
            n, conv, children, leaves, saved = n + more, least if conv is None else min(conv, least), children + 1, leaves + ends, saved + gain
        if not opened:
            leaves, saved = leaves if children else 1, saved + (n - 1) * words
            if parent is not None:
                queue.push((1 - depth, parent, n, conv, leaves, saved))
        yield shard, depth, node, parent, words, sha, opened, n, conv, children, leaves, saved
    if queue:
        queue.close()


def _time_forward(nodes: DataFrame, most: int) -> DataFrame:
    folder = shared_folder(nodes.sparkSession, "messages")
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "node")
    return in_arrow(ordered, lambda batches: _batches(_totals(batches, folder, most), NODE), NODE)


def prefix_trie(sequences: DataFrame, queue: int = QUEUE) -> DataFrame:
    """Every node of the trie of ``sequences`` (conv_id, digests, words): one row per distinct prefix, the empty one included.

    ``node`` and ``parent`` are hashes of the prefixes; the rest is what the query returns.
    """
    end = F.aggregate("digests", F.lit(ROOT), lambda node, digest: F.md5(F.concat(node, digest)))
    sequences = stored(sequences.withColumn("node", end), "sequences")
    distinct = sequences.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("digests").alias("digests"), F.first("words").alias("words"))
    whole = distinct.join(_ends(sequences), "node").drop("node")
    ranged = stored(whole.repartitionByRange("digests").sortWithinPartitions("digests").withColumn("shard", F.spark_partition_id()), "shards")
    # a row for each shard
    along = Window.orderBy("shard")
    borders = ranged.groupBy("shard").agg(F.min("digests").alias("lo"), F.max("digests").alias("hi")) \
        .select("shard", _shared(F.lag("hi").over(along), F.col("lo")).alias("before"), _shared(F.col("hi"), F.lead("lo").over(along)).alias("after"))
    rows = ranged.join(borders, "shard").repartition("shard").sortWithinPartitions("shard", "digests")
    nodes = in_arrow(rows, lambda batches: _batches(_nodes(batches), NODE), NODE)
    inner = stored(_time_forward(nodes, queue), "nodes")
    merged = inner.where("open").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.max("words").alias("words"), F.max("ends_sha256").alias("ends_sha256"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.min("conv_id").alias("conv_id"))
    shared = merged.withColumns({"shard": F.lit(-1), "open": F.lit(False)}).select(*inner.columns)
    done = stored(inner.where("NOT open").unionByName(_time_forward(shared, queue)), "trie")
    above = done.select(F.col("node").alias("__above"), F.col("conv_id").alias("parent_conv_id"))
    return done.join(above, F.col("parent") == F.col("__above"), "left").select(
        "node", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
