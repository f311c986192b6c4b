import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, size string, row_id string, dk string, s string, n_words string, score string"


def rows_of(texts, ids=None, langs=None, sources=None):
    ids = ids if ids is not None else list(range(len(texts)))
    langs, sources = langs or ["en"] * len(texts), sources or ["a"] * len(texts)
    return [(i, t, la, so, len(t or ""), *["x"] * 7) for i, t, la, so in zip(ids, texts, langs, sources)]


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table with columns whose names clash with those that operators use inside."""

    def make(texts, ids=None, **more):
        return spark.createDataFrame(rows_of(texts, ids, **more), SCHEMA).repartition(3)

    return make


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, ties and repeated rows, other scripts."""
    long = prose(1, 30_000)
    return [None, "", " \n\t", "one", "One.", long, long, "é ü 漢字 \U0001f600", "same text here today", "same text here today", "12 34", "a" * 5000]
