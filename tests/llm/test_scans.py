"""Quality rules, classifier, licence scan, fingerprints and BPE against plain Python."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from cargoloom.llm import bpe, classifier, license_scan, quality_rules, winnow
from cargoloom.llm.common import steps
from cargoloom.llm.words import U, mix, running, span_hash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " \n\t ", "one", "Élan\x0bvital x", "a b c d e f g h " * 5, "same line\nsame line\n\nsame line x", "#tag *a* $5 50% A&B <b>|", "word " * 4000,
         "under the MIT license, under the MIT license", "漢字 🙂 漢字", "".join(random.Random(1).choice("abcdefghij \n") for _ in range(9000))]


def documents(spark, texts=TEXTS):
    """Columns that clash with names used inside, ids that repeat and one that is null."""
    rows = [(i, t, i, "w", i) for i, t in enumerate(texts)] + [(3, "one", 7, "w", 1), (None, "no id", 1, "w", 1)]
    return spark.createDataFrame(rows, "doc_id int, text string, row long, words string, kept long")


def by_id(df):
    return {(r.doc_id, i): r for i, r in enumerate(sorted(df.collect(), key=lambda r: str(r.doc_id)))}


def brute_rules(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_rules_count_like_plain_python(spark):
    rows = quality_rules.quality_rules(documents(spark)).collect()
    assert len(rows) == len(TEXTS) + 2 and any(r.doc_id is None for r in rows)
    for r in rows:
        text = "no id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        want = brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.reason is None)
    assert quality_rules.quality_rules(documents(spark).limit(0)).count() == 0


def test_bands_refuse_repetition_and_noise():
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(400))
    noise = base64.b64encode(random.Random(3).randbytes(9000)).decode()
    judge = lambda t: quality_rules.band_reason(len(t), *quality_rules._ratios(t.encode(), quality_rules.zstandard.ZstdCompressor(level=3)))
    assert judge(prose) is None and judge("ab" * 5000) == "repetitive" and judge("short") is None
    # Random bytes written as text compress to about 0.79, random base64 to 0.75: inside the band of their lengths.
    assert judge(noise) is None and quality_rules.band_reason(5000, 0.86, 0.0) == "incompressible" and quality_rules.band_reason(5000, 0.5, 0.4) == "odd chunks"


def test_passing_keeps_columns(spark):
    docs = documents(spark, ["good words " + " ".join(f"w{i}x{i * 7}" for i in range(60)), "short", None])
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]


def test_classifier_tells_held_out_rows_apart(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    good = lambda: " ".join(rng.choice(vocabulary) for _ in range(80))
    rows = [(i, good() if i % 3 else " ".join(w.upper() + "!!" for w in good().split()), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, labels)
    found = classifier.classify(docs, model).collect()
    asked = [r for r in found if r.held_out]
    assert len(found) == 401 and len(asked) > 50 and np.mean([r.predicted == (r.doc_id % 3 > 0) for r in asked]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)
    assert classifier.classify(docs.limit(0), model).count() == 0
    unlabelled = classifier.classify(docs, classifier.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in unlabelled} == {0.5}


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    from cargoloom.llm.common import held_out
    flipped = labels.withColumn("quality", __import__("pyspark").sql.functions.when(held_out(labels["doc_id"]), 1 - labels["quality"]).otherwise(labels["quality"]).cast("int"))
    a, b = classifier.fit(docs, labels), classifier.fit(docs, flipped)
    assert a.bias == b.bias and (a.weight == b.weight).all()


def brute_licence(text):
    words, places, labels = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOWER)), [], set()
    for label, phrases in license_scan.PHRASES.items():
        for phrase in (p.split() for p in phrases):
            for i in range(len(words) - len(phrase) + 1):
                if words[i:i + len(phrase)] == phrase:
                    places.append(i)
                    labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENCES = ["cc by nc cc by nc CC-BY-NC", "x apache license version 2 " * 300, "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software and its associated documentation files",
            "cc by", "the mit license under the mit licence"]


def test_licence_places(spark):
    texts = TEXTS + LICENCES
    rows = license_scan.license_scan(documents(spark, texts)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licence("no id" if r.doc_id is None else texts[r.doc_id] or "")
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    near = next(r for r in rows if r.doc_id == len(TEXTS) + 2)
    assert near.labels == "mit" and near.n_base == 0 and near.score > 0.8
    assert license_scan.license_scan(documents(spark).limit(0)).count() == 0
    spans = license_scan.license_spans(documents(spark, LICENCES[:1])).collect()
    assert sorted((s.label, s.first_word, s.last_word) for s in spans) == [("cc-by-nc", i, i + 2) for i in (0, 3, 6)]


def brute_winnow(text, k, window):
    if not text:
        return []
    sums, size = running(mix(np.array([ord(c) for c in text], U) + U(1))), min(len(text), k)
    hashes = [int(span_hash(sums, np.array([i]), np.array([i + size]))[0]) >> 32 for i in range(len(text) - size + 1)]
    kept = []
    for i in range(max(1, len(hashes) - window + 1)):
        some = hashes[i:i + window]
        place = i + max(j for j, h in enumerate(some) if h == min(some))
        if not kept or kept[-1][1] != place:
            kept.append((min(some), place))
    return kept


@pytest.mark.parametrize("k, window", [(16, 32), (3, 5), (4, 1), (2, 7)])
def test_winnowing_keeps_the_rightmost_smallest(k, window):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é🙂") for _ in range(rng.choice([0, 1, 5, 15, 16, 17, 46, 47, 48, 200]))) for _ in range(120)] + ["a" * 100]
    hashes, places, offsets = winnow.fingerprints(texts, k, window)
    for i, text in enumerate(texts):
        assert list(zip(hashes[offsets[i]:offsets[i + 1]].tolist(), places[offsets[i]:offsets[i + 1]].tolist())) == brute_winnow(text, k, window)


def test_a_shared_run_shares_a_fingerprint():
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(30):
        shared = some(winnow.K + winnow.WINDOW - 1)
        hashes, _, offsets = winnow.fingerprints([some(90) + shared + some(33), some(10) + shared])
        assert set(hashes[:offsets[1]].tolist()) & set(hashes[offsets[1]:].tolist())


@pytest.mark.parametrize("rows", [[], [(1, "abc")], [(None, "abcdef"), (None, None), (3, "xyz123"), (3, "xyz124")], [(i * 7 % 101, "t" * i + str(i)) for i in range(101)]])
def test_edited_texts_take_the_next_head(spark, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        want[key, len(text), hashlib.sha256((text[:len(text) - n] + after[:n]).encode()).hexdigest()] += 1
    found = winnow.edited_likeness(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block long")).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_bpe_is_the_library_s(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    long = ["a" * 3000, "thequickbrownfox" * 60, "".join(rng.choice("etaoinshrdlu") for _ in range(700)), " " * 400, "ü" * 200, "!" * 500]
    pieces = [" ", "  ", "\n", "　", "\x1c", "\x85", "a", "Foo", "don't", "42", "...", "é", "漢字", "🙂", "<|endoftext|>", "'ll", "ñandú"]
    texts = TEXTS + long + ["".join(rng.choice(pieces) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(300)]
    docs = documents(spark, texts).repartition(8)
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert list(r.ids) == library.encode_ordinary(text) and bytes(r.decoded) == text.encode(), repr(text[:60])


def one_by_one(ranks, word):
    """The leftmost lowest pair again and again."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_folds_ranks_of_any_kind():
    rng, kinds = random.Random(8), set()
    for trial in range(60):
        own = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(rng.randint(0, 12))}, key=lambda t: (len(t), rng.random()) if trial % 2 else rng.random())
        ranks = {bytes([b]): b for b in range(256)} | {token: 256 + i for i, token in enumerate(own)}
        table = bpe._rank_table(ranks)
        kinds.add(table.at_once)
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))).encode() for _ in range(50)] + [b"a" * 30]
        ids, offsets = table.fold(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [one_by_one(ranks, w) for w in words]
    assert kinds == {True, False}


def test_bpe_shuffles_nothing(spark):
    plan = bpe.decode(bpe.encode(documents(spark, TEXTS)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Subquery" not in plan


def test_decoding_unknown_and_null_ids(spark):
    rows = spark.createDataFrame([(1, [5, 60000, -1, None, 6], "x"), (2, None, "y"), (3, [], "z")], "doc_id long, ids array<int>, other string")
    tokens = bpe.merge_table(bpe.DEFAULT_RANKS).tokens
    assert {(r.doc_id, r.other, r.decoded and bytes(r.decoded)) for r in bpe.decode(rows).collect()} == {(1, "x", tokens[5] + tokens[6]), (2, "y", None), (3, "z", b"")}


def test_steps_cut_between_rows():
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["ab", None, "c" * 10, "", "dé"], kind)[1:]
        got = [data[o:p].tobytes().decode() for _, _, data, offsets in steps(column, 3) for o, p in zip(offsets[:-1], offsets[1:])]
        assert got == ["", "c" * 10, "", "dé"]
