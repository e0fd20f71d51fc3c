"""Token ids by chunks against the tokenizers library on whole texts; addressable files; packing."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargoloom.llm import dac, packing, tokens

PIECES = [" ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", " ", "a", "Foo", "bar's", "don't", "42", "...", "é", "ß", "漢字", "🙂", "<|endoftext|>", "x" * 70, "-", "word", "'ll", "ñandú"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.DEFAULT_VOCABULARY)


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_whole_text(library):
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "\n a", "x  y"] + random_texts(3000)
    ids, offsets = tokens.ChunkEncoder(tokens.DEFAULT_VOCABULARY).encode(texts)
    for i, text in enumerate(texts):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_an_added_token_in_a_text_has_its_own_id():
    ids, _ = tokens.ChunkEncoder(tokens.DEFAULT_VOCABULARY).encode(["hello <|endoftext|> world"])
    assert ids.tolist() == [31373, 220, 50256, 995]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    own = tokens.ChunkEncoder(tokens.DEFAULT_VOCABULARY)
    for seed in range(30):
        texts = random_texts(20, seed)
        ids, offsets = own.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_words_that_meet_at_line_ends_are_no_chunks_of_their_own(library):
    words = [f"word{chr(97 + i)}." for i in range(20)]
    texts = [f"{a}{end}{b} {a}" for a in words for b in words for end in ("\n", "\n\n")] + [None, "", None, "\n", "a \nb", "a\r\nb", "a\n b", "\n\na", " \na\n", "a\n \nb", "a\n\n\n\n\nb"]
    own = tokens.ChunkEncoder(tokens.DEFAULT_VOCABULARY)
    ids, offsets = own.encode(pa.array(texts, pa.string())[1:])
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]
    assert own.count < 10 * len(words)


def test_levels_give_back_every_token():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(1), np.array([255, 256, 65535, 65536, 2**32 - 1]), rng.integers(0, 60000, 5000), np.zeros(0)):
        ids = ids.astype(np.uint32)
        segment = dac.Segment(dac.segment_bytes(np.array([4, 9]), np.array([False, True]), np.array([len(ids), 0]), ids))
        assert segment.all().tolist() == ids.tolist()
        assert [segment.token(i) for i in range(len(ids))] == ids.tolist()
        keys, nulls, sizes = segment.documents()
        assert keys.tolist() == [4, 9] and nulls.tolist() == [False, True] and sizes.tolist() == [len(ids), 0]


DOCS = [(5, "Hello  world", "x"), (1, None, "x"), (3, "", "y"), (5, "Hello  world", None), (None, "no id", "z"), (2, "a " * 3000, "z"), (9, "漢字 🙂", "z")]


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "start")


def test_files_in_order_with_starts(spark, library):
    manifest = dac.write_dac(documents(spark))
    rows = sorted(dac.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 5, 5, 9]
    flat, start = [], 0
    for r, text in zip(rows, ["no id", "", "a " * 3000, "", "Hello  world", "Hello  world", "漢字 🙂"]):
        want = library.encode(text, add_special_tokens=False).ids + [0]
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want and (r.start, r.n_tokens) == (start, len(want))
        flat, start = flat + want, start + len(want)
    places = [0, 1, len(flat) - 1, len(flat), -1, None, 17, 17]
    got = dac.tokens_at(manifest, spark.createDataFrame([(i,) for i in places], "place long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, flat[i] if i is not None and 0 <= i < len(flat) else None) for i in places], key=str)


def test_no_documents_no_files(spark):
    manifest = dac.write_dac(documents(spark, []))
    assert manifest.count() == 0 and dac.read_documents(manifest).count() == 0


def test_random_access_reads_from_the_file(spark, library):
    path = dac.write_dac(documents(spark)).orderBy("file_no").first().path
    file, ids = dac.DacFile(path), library.encode("no id", add_special_tokens=False).ids + [0]
    assert [file.token(i) for i in range(len(ids))] == ids
    with pytest.raises(IndexError):
        file.token(int(file.first[-1]))


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert bins.add(6, "a") == [] and bins.add(7, "b") == []
    assert bins.add(3, "c") == [(1, [(0, "b"), (7, "c")])]
    assert bins.add(5, "d") == []
    assert bins.add(8, "e") == [(0, [(0, "a")])]  # a had less room than d
    assert sorted(bins.rest()) == [(2, [(0, "d")]), (3, [(0, "e")])]


@pytest.mark.parametrize("n", [1, 5, 10, 11, 20, 27])
def test_only_long_documents_are_cut(n):
    pieces = packing.cut(n, 10)
    assert sum(length for _, length in pieces) == n and all(length == 10 for _, length in pieces[1:])
    assert [start for start, _ in pieces] == [sum(l for _, l in pieces[:i]) for i in range(len(pieces))]


def test_packing_is_whole_and_gapless(spark, library):
    rows = DOCS + [(100 + i, "word " * (i % 90), "s") for i in range(400)]
    placed = packing.best_fit_packing(documents(spark, rows), capacity=64, open_bins=4).collect()
    whole = {}
    for key, text, _ in rows:
        whole.setdefault(key, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    for r in placed:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() in [ids[r.start:r.start + r.length] for ids in whole[r.doc_id]]
    assert sum(r.length for r in placed) == sum(len(i) for some in whole.values() for i in some)
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(r.length for r in placed)
    assert len(sequences) <= 1.2 * total / 64 + 2
    assert packing.best_fit_packing(documents(spark, [])).count() == 0
