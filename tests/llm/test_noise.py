"""Quality rules on clean text and noise of each length."""

import base64
import random
import string

import pytest

from cargoloom.llm import quality_rules

CHARS = string.ascii_letters + string.digits


def in_words(rng, text):
    out = []
    while text:
        n = rng.randrange(3, 10)
        out.append(text[:n])
        text = text[n:]
    return " ".join(out)


NOISES = {
    "base64 words": lambda rng, n: in_words(rng, base64.b64encode(rng.randbytes(n)).decode()),
    "base64 lines": lambda rng, n: "a b c d e f g h i j k l m n o p q r s t u\n" * (n >= 4096) + "\n".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(max(n // 70, 20))),
    "letters and digits": lambda rng, n: in_words(rng, "".join(rng.choice(CHARS) for _ in range(n))),
    "bytes": lambda rng, n: in_words(rng, "".join(chr(rng.randrange(33, 256)) for _ in range(n))),
}


def prose(rng, n):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ing", "st", "en", "ti", "es", "or", "al"]) for _ in range(rng.randrange(1, 4))) for _ in range(600)]
    text = ""
    while len(text) < n:
        text += rng.choice(words) + rng.choice([" "] * 8 + [", ", ". "])
    return text[:n]


@pytest.mark.parametrize("size", [300, 600, 1024, 3000, 9000, 30000])
def test_noise_goes_and_prose_stays(spark, size):
    rng = random.Random(size)
    rows = [(i, make(rng, size)) for i, make in enumerate(NOISES.values())] + [(10 + i, prose(rng, size)) for i in range(4)]
    if size >= 9000:
        rows.append((9, prose(rng, size // 2) + " " + NOISES["base64 words"](rng, size // 2)))
    found = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in found.items() if r.kept} == set(range(10, 14)), found
    assert all(r.reason in ("incompressible", "odd chunks") for i, r in found.items() if i < 10)
