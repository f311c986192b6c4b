"""The substring index against a brute-force version."""

import random

from spindrift.operators import substrings


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abÀ .é𝄞") for _ in range(rnd.choice([0, 1, 2, 5, 60, 400])))) for i in range(120)]
    texts += [(200, None), (None, "abab"), (201, ""), (5, texts[7][1]), (5, texts[7][1])]  # ids and rows that repeat
    texts += [(300 + i, "abc " * 50) for i in range(40)]  # copies
    cut = lambda t: t[(a := rnd.randrange(len(t))) : a + rnd.choice([1, 2, 3, 4, 12])]
    asked = [(i % 50, cut(rnd.choice([t for _, t in texts[:120] if t]))) for i in range(90)]
    asked += [(90, "ABC A"), (91, "abc a"), (92, ""), (93, None), (94, "zzzz"), (95, "a𝄞"), (96, "x" * 500)]
    want = {(q, c) for q, s in asked if s for c, t in texts if t is not None and c is not None and s.lower() in t.lower()}
    rows = spark.createDataFrame(texts, "chunk_id long, text string").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, q string")
    postings = substrings.build(rows)
    for rare in (1, 6, 50):
        got = substrings.search(queries, postings, rows, rare).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.setattr(substrings, "TOGETHER", 7)
    assert {tuple(r) for r in substrings.search(queries, postings, rows).collect()} == want
    monkeypatch.setattr(substrings, "LEXICON", 0)  # candidates carry their strings
    assert {tuple(r) for r in substrings.search(queries, postings, rows).collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "chunk_id long, text string")
    rows = spark.createDataFrame([(1, "some text")], "chunk_id long, text string")
    ask, nobody = spark.createDataFrame([(1, "text")], "query_id long, q string"), spark.createDataFrame([], "query_id long, q string")
    assert substrings.search(ask, substrings.build(none), none).count() == 0
    assert substrings.search(nobody, substrings.build(rows), rows).count() == 0


def test_few_texts_are_compared(spark):
    """The rarest grams leave few texts, and a text is in a block's list once."""
    rnd = random.Random(5)
    texts = [(i, " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(30))) for i in range(300)]
    rows = spark.createDataFrame(texts, "chunk_id long, text string")
    needles = spark.createDataFrame([(i, texts[i][1][20:80]) for i in range(0, 300, 10)], "no long, q string")
    postings = substrings.build(rows)
    assert postings.filter("n <> size(array_distinct(ids))").count() == 0
    assert substrings.candidates(needles, postings).count() <= 60
