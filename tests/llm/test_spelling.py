"""Near words and forms, against a comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from cargoloom.llm.spelling import Index, near_words, spelling_variants

LOWER = {c: c + 32 for c in range(65, 91)}


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def _plain(counts):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    best = {w: min(some, key=lambda v: (-counts[v], v)) for w, some in near.items() if some}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, n, len(near[w]), form.get(w, ""), counts[form[w]] if w in form else 0, root(w)) for w, n in counts.items())


def _words(rng, many, letters="abéÿ", sizes=(7, 12)):
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(*sizes))) for _ in range(many)}
    for w in list(words)[:many // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:], w + rng.choice(letters), rng.choice(letters) + w}
    return {w for w in words if len(w) >= 7}


def test_an_index_finds_all_pairs_that_agree_in_the_first_half():
    words = sorted(_words(random.Random(1), 120))
    index = Index(words[::2])
    half = [len(w) // 2 for w in words]
    import numpy as np
    who, found = index.near(words, np.array(half))
    got = sorted((words[a], index.words[b]) for a, b in zip(who, found))
    assert got == sorted((a, b) for a, h in zip(words, half) for b in words[::2] if b.startswith(a[:h]) and _near(a, b))
    assert len(got) > 50


def test_shards_and_parts_give_the_same_counts(spark):
    rng = random.Random(2)
    counts = {w: rng.choice([2, 3, 20, 300]) for w in _words(rng, 60) | _words(rng, 60, "ab", (7, 9))}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    plain = {w: (m, f) for w, _, m, f, _, _ in _plain(counts) if m}
    for shard, most in ((10_000, 10_000), (7, 5)):
        got = {r["word"]: r for r in near_words(rows, shard, most).collect()}
        assert {w: r["n_near"] for w, r in got.items()} == {w: m for w, (m, _) in plain.items()}
        assert all(got[w]["best"] == f for w, (_, f) in plain.items() if f)


def test_whole_texts_against_all_pairs(spark):
    rng = random.Random(3)
    pool = sorted(_words(rng, 40))
    weights = [rng.choice([1, 5, 80, 1200]) for _ in pool]
    docs = [(i, ", ".join((w.upper() if rng.random() < .3 and w.isascii() else w) for w in rng.choices(pool, weights, k=400))) for i in range(12)]
    docs += [(None, "aaaaaaaa aaaaaaaa Àbababab Àbababab àbababab"), (3, docs[3][1]), (4, None), (5, ""), (6, "short words × only"), (7, "b" * 5000 + " " + "b" * 5001 + " " + "b" * 5000 + " " + "b" * 5001)]
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, word string").repartition(3)
    got = sorted((r["word"], r["n"], r["n_near"], r["form"] or "", r["form_n"] or 0, r["root"]) for r in spelling_variants(table).collect())
    assert got == _plain(counts)
    assert any(r[5] != r[0] for r in got)


def test_empty_tables_give_no_rows(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, "no long ones")], "doc_id long, text string")).collect() == []
