"""The trie of rebuilt conversations, against a plain one and with many shards and spilled messages."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cargoloom.llm.prefix_trie import prefix_trie, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [t[2] for t in sorted(some)] for c, some in own.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, some in whole.items():
        for d in range(len(some) + 1):
            members[some[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == n).encode()).hexdigest()) for n, m in members.items()), key=str)


def _rows(trie):
    return sorted((tuple(r) for r in trie.select(*COLUMNS).collect()), key=str)


def _conversations(seed, convs, deep=0):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hello there", "a b c", "x", "", "tab\tone"])))
    return rows + [(convs + 3, i, "user", f"step {i % 3} on") for i in range(deep)] + [(convs + 4, i, "user", f"step {i % 3} on") for i in range(deep // 2)]


def test_equal_to_a_plain_trie_over_many_shards(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _conversations(1, 150, deep=90) + [(7, None, "user", "first of all"), (7, None, None, None), (7, 1, "user", "x"), (7, 1, "user", "x"), (None, 0, "user", "nobody"), (-45, 0, "user", "a b c")]
        got = prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA).repartition(4)), queue=20)
        assert _rows(got) == _plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_copies_and_a_common_first_turn(spark):
    rows = [(c, t, "user", ["same start", "same middle", "same end"][t]) for c in range(0, 2000, 20) for t in range(3)] + [(5000 + 20 * c, t, "user", ["same start", f"own {c}"][t]) for c in range(60) for t in range(2)]
    assert _rows(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))) == _plain(rows)


def test_turnless_conversations_and_empty_and_clashing_tables(spark):
    # conversations without turns of their own behind the first h, and none in the block's first one
    rows = [(c, 0, "user", "only") for c in range(21, 40)]
    assert _rows(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))) == _plain(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in _plain(rows))
    empty = spark.createDataFrame([], SCHEMA)
    assert _rows(prefix_trie(rebuilt(empty))) == []
    extra = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit(1), "digest": F.lit("x"), "shard": F.lit(2), "n": F.lit(0)})
    assert _rows(prefix_trie(rebuilt(extra))) == _plain(rows)


def test_a_very_long_text_is_one_turn(spark):
    rows = [(0, 0, "user", "word " * 300_000), (1, 0, "user", "b"), (1, 1, "user", "c"), (1, 2, "user", "d"), (1, 3, "user", "e")]
    assert _rows(prefix_trie(rebuilt(spark.createDataFrame(rows, SCHEMA)))) == _plain(rows)
