"""Components, stars, near-duplicates and line dedup against brute force; archives; the pipeline."""

import gzip
import io
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cargoloom.llm import line_dedup, minhash, warc
from cargoloom.llm.components import components
from cargoloom.llm.stars import star_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_components_reach_the_smallest(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2200)]
    groups = Groups()
    for a, b in links:
        groups.join(a, b)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {n: groups.find(n) for a, b in links if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_stars_lose_no_pair_of_a_bucket(spark):
    rng = random.Random(6)
    entries = [(key, node) for key in range(12) for node in rng.sample(range(60), 18)]
    linked = lambda a, b: (a * 31 + b * 31 + a * b) % 23 == 0
    groups = Groups()
    for key in range(12):
        for a, b in itertools.combinations(sorted(n for k, n in entries if k == key), 2):
            if linked(a, b):
                groups.join(a, b)
    confirm = lambda nodes: lambda pairs: pairs.where("(c * 31 + v * 31 + c * v) % 23 = 0")
    facts = spark.createDataFrame([(n, n) for n in range(60)], "node long, fact long")
    may = lambda a, b: a.isNotNull() & b.isNotNull()
    found = {r.node: r.component for r in star_components(spark.createDataFrame(entries, "key long, node long"), facts, may, confirm).collect()}
    # Later rounds may also ask pairs that share no bucket, so more true links can show, but none of a bucket is lost.
    every = Groups()
    for a, b in itertools.combinations(range(60), 2):
        if linked(a, b):
            every.join(a, b)
    nodes = {n for _, n in entries}
    for a, b in itertools.combinations(nodes, 2):
        together = found.get(a, a) == found.get(b, b)
        assert together or groups.find(a) != groups.find(b)
        assert not together or every.find(a) == every.find(b)


def brute_near(rows, k, percent):
    sets = {}
    for key, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets[key] = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    groups = Groups()
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            groups.join(a, b)
    return {key: (len(s), groups.find(key)) for key, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = random.Random(k)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.choice([1, 2, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 7])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 3, 8]) * len(copy) // 60):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "Solo", "solo", "solo\n"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows] + [(3, texts[3], 0, "x"), (None, texts[3], 0, "x")], "doc_id long, text string, component_id long, keys string")
    found = minhash.near_duplicates(docs, words=k).collect()
    assert len(found) == len(rows) + 2
    want = brute_near(rows, k, 80)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_densified_bins_are_filled_and_equal_for_equal_sets():
    data = np.frombuffer(b"one two three four one two three four", np.uint8)
    for n_rows in (1, 2):
        offsets = np.array([0, len(data)]) if n_rows == 1 else np.array([0, 18, len(data)])
        runs, rows = minhash.shingles(data, offsets, 2)
        signature = minhash.signatures(runs, rows, n_rows, 240)
        assert (signature < np.iinfo(np.uint64).max).all()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    some = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(14)))
    for _ in range(1500):
        a, b = some(), some()
        assert line_dedup.edit_distance(a, b) == plain_distance(a, b), (a, b)


def test_simhashes_that_differ_in_three_bits_share_a_key():
    rng = random.Random(9)
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), 3):
            y ^= 1 << bit
        a, b = line_dedup.block_keys(np.array([x, y], np.uint64))
        assert set(a.tolist()) & set(b.tolist())


LONG = "the quick brown fox jumps over the lazy dog while seventeen other animals look on from the far side of a slow river near town"
LINES = [(4, f"{LONG}\nsecond one here\n\n!!!"), (2, f"first unique line\n{LONG.upper()}!"), (7, LONG.replace("slow", "slaw") + "\nsecond  ONE, here"), (9, None), (8, ""), (2, "x\nx\nx"), (None, "x\ny")]


def test_lines_keep_the_first_of_each_group(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in LINES], "doc_id long, text string, line string, a long")
    found = line_dedup.repeated_lines(docs)
    cleaned = line_dedup.without_lines(docs, found)
    assert cleaned.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in cleaned.collect())
    assert texts == Counter([(4, "second one here\n\n!!!"), (2, f"first unique line\n{LONG.upper()}!"), (7, ""), (9, None), (8, ""), (2, "x"), (None, "y")])
    assert {(r.doc_id, r.n_lines, len(r.removed)) for r in found.collect()} == {(4, 4, 1), (2, 2, 0), (7, 2, 2), (9, 1, 0), (8, 1, 0), (2, 3, 2), (None, 2, 1)}
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_equal_lines_go_whatever_their_case_and_signs(spark):
    rng = random.Random(11)
    lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(9)) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice([str.upper, str, lambda x: f"- {x}."])(rng.choice(lines)) for _ in range(6))) for i in range(60)]
    found = {r.doc_id: list(r.removed) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen, want = set(), defaultdict(list)
    for i, text in rows:
        for n, line in enumerate(text.split("\n")):
            line = " ".join(re.findall("[a-z0-9]+", line.lower()))
            if line in seen:
                want[i].append(n)
            seen.add(line)
    assert found == {i: want[i] for i, _ in rows}


PAGES = [(1, "u v\n", "a" * 100_000, 1), (2, None, "a" * 100_000, 1), (3, "x", None, 1), (None, "x", "", 1), (4, "x", "é<b>", 1), (4, "x", "é<b>", 1), (5, "x", "", 1), (6, "y", "solo", 1)]


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, first long")
    manifest = warc.write_warc(pages, least_bytes=least)
    found = warc.read_warc(manifest).collect()
    bodies = [(i, (h or "").encode()) for i, _, h, _ in PAGES]
    first = {b: max((i for i, x in bodies if x == b and i is not None), default=None) for _, b in bodies}
    want = []
    for i, b in bodies:
        to = first[b] if len(b) >= least and i != first[b] and sum(x == b for _, x in bodies) > 1 else None
        want.append((i, len(b), warc.base32_sha1(b), "response" if to is None else "revisit", to, b if to is None else None))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in found) == Counter(want)
    empty = warc.write_warc(pages.limit(0))
    assert empty.count() == 0 and warc.read_warc(empty).count() == 0


def test_one_member_a_record_and_damage_is_found():
    records = [warc.record_bytes(1, "u", b"hello"), warc.record_bytes(2, "u", b"hello", refers_to=1), warc.record_bytes(3, None, b"\r\n\r\n" * 30_000)]
    archive = b"".join(map(warc.member, records))
    assert gzip.decompress(archive) == b"".join(records)
    read = lambda data: list(warc.read_records(io.BytesIO(data)))
    assert [(r[0], r[2], r[4], r[6]) for r in read(archive)] == [(1, "response", 5, None), (2, "revisit", 5, 1), (3, "response", 120_000, None)]
    for bad in (archive[:-3], warc.member(records[0].replace(b"hello", b"hellx")), warc.member(records[0][:-1]), warc.member(records[0] + b"x")):
        with pytest.raises(ValueError):
            read(bad)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(500)]
    prose = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(n))
    rows = [(i, prose(12), "en", "s", 0, 1) for i in range(60)]
    rows += [(100 + i, " ".join(w + "***" for w in prose(10).split()), "en", "s", 0, 0) for i in range(40)]
    rows += [(200, "too short", "en", "s", 0, None), (201, None, "en", "s", 0, None), (202, "spam spam " * 200, "en", "s", 0, 0)]
    rows += [(300, rows[0][1], "en", "s", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int")
    docs.drop("quality").write.parquet(str(tmp_path / "documents.parquet"))
    docs.where("quality is not null").selectExpr("doc_id", "quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    left, columns = docs.drop("quality"), docs.drop("quality").columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.stored(stage(spark, left, str(tmp_path)), "test")
        kept[name] = sorted({r.doc_id for r in left.select("doc_id").collect()})
        assert name == "best_fit_packing" or left.columns == columns
    assert set(range(60)) <= set(kept["quality_classifier"]) and not {200, 201, 202} & set(kept["quality_rules"])
    assert not set(range(100, 140)) & set(kept["quality_classifier"])
    assert set(range(60)) <= set(kept["best_fit_packing"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted({r.doc_id for r in whole.collect()}) == kept["best_fit_packing"]
