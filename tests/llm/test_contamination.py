"""Windows of benchmark items in documents, against a plain search."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from cargoloom.llm.decontaminate import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _plain(docs, items, span=10):
    out = []
    for doc_id, text in docs:
        words, hit, found = _words(text), set(), set()
        for item, source in items:
            own = _words(source)
            n = min(len(own), span)
            wanted = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]


def _order(rows):
    return sorted(rows, key=str)


def test_equal_to_a_plain_search_with_items_of_all_lengths(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["Tor", "tor", "ë", "a", "b", "c1", "z"])
    line = lambda n: rng.choice([" ", ", "]).join(word() for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, 3, 5, 7, 9, 10, 11, 14, 25]))) for i in range(30)] + [(None, line(12)), (7, line(13)), (40, None), (41, "--")]
    docs = [(i, line(rng.randrange(60))) for i in range(40)]
    docs += [(100 + i, f"{line(9)}; {items[rng.randrange(30)][1].upper()} {line(4)}") for i in range(20)]
    docs += [(None, docs[-1][1]), (5, docs[-1][1]), (5, docs[-1][1]), (6, None), (7, ""), (8, "?!")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert _order(_rows(got)) == _order(_plain(docs, items))


def test_pieces_of_a_long_text_join_and_spans_stand_at_their_words(spark, monkeypatch):
    rng = random.Random(4)
    item = " ".join(f"p{rng.randrange(10**6)}" for _ in range(30))
    text = " ".join(["filler"] * 95) + f" {item} " + " ".join(f"w{i % 9}" for i in range(300))
    monkeypatch.setattr("cargoloom.llm.decontaminate.PIECE", 100)
    got = contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert _rows(got) == _plain([(1, text)], [(9, item)])
    assert got.select(F.array_min("spans.first"), F.array_max("spans.end")).first() == (95, 125)


def test_shuffled_joins_give_the_same_rows(spark, monkeypatch):
    docs = [(i, f"lead {i} one two three four five six seven eight nine ten eleven") for i in range(50)] + [(99, "clean")]
    items = [(i, "One two three four five six seven eight nine ten") for i in range(20)] + [(30, "lead 7")]
    monkeypatch.setattr("cargoloom.llm.decontaminate.BROADCAST_WINDOWS", 0)
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert _order(_rows(got)) == _order(_plain(docs, items))


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2, 3)], "doc_id long, text string, words string, row int, item_id int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert _rows(contamination(docs, none)) == _plain([(1, "a b")], [])
    items = spark.createDataFrame([(4, "b", "y")], "item_id long, text string, doc_id string")
    assert _rows(contamination(docs, items)) == _plain([(1, "a b")], [(4, "b")])
    assert _rows(contamination(docs.limit(0), items)) == []
