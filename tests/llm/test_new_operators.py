"""Periodic runs, whitening and SentencePiece ids, against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spindrift.llm import periodic_runs, pieces, queries, whitening

from .conftest import prose

SF = "/root/testdata/sf0.001"


def _runs(w):
    """All runs of a list of words, period by period."""
    found, out = set(), []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j) not in found and not any(a == i and a + n == j + q for a, n, _ in out):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _looped(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_match_brute_force(letters):
    r = random.Random(letters)
    for _ in range(400):
        w = [r.randint(0, letters) for _ in range(r.randint(0, 110))]
        for _ in range(r.randint(0, 4)):
            p, s, n = r.randint(1, max(1, len(w) // 4)), r.randint(0, 100), r.randint(1, 110)
            for i in range(s + p, min(len(w), s + n)):
                w[i] = w[i - p]
        got = [*zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(w, np.int64))))]
        assert got == _runs(w)


def test_runs_of_long_and_nested_sequences():
    find = lambda w: [*zip(*(x.tolist() for x in periodic_runs.find_runs(np.array(w))))]
    assert find([7] * 100_000) == [(0, 100_000, 1)]
    assert find([*range(5001)] * 5) == [(0, 25005, 5001)]
    inner = [0] * 10 + [1] * 10
    assert find(inner * 6) == sorted([(0, 120, 20)] + [(10 * k, 10, 1) for k in range(12)], key=lambda r: (r[0], r[2]))
    assert find([]) == find([1] * 5) == [] and find([1] * 6) == [(0, 6, 1)]


@pytest.mark.parametrize("p, g", periodic_runs.PRIMES)
def test_correlations_are_exact(p, g):
    r = np.random.default_rng(p)
    for size in (1, 2, 8, 64):
        a, t = r.integers(0, p, (5, size)), r.integers(0, p, (5, 2 * size))
        want = [[sum(int(x) * int(y) for x, y in zip(a[k], t[k, d:])) % p for d in range(size)] for k in range(5)]
        assert periodic_runs.correlations(a, t, p, g).tolist() == want


def test_large_ids_take_more_primes():
    ids = np.arange(1, 6001) * 300_000 % 1_999_993
    ids[3000:] = ids[:3000]
    rows, d = periodic_runs.matches(ids, np.array([0, 2048]), 2048)
    assert (rows.tolist(), d.tolist()) == ([0], [3000])


def test_query_of_runs(spark, frame, odd_texts):
    texts = odd_texts + ["a b " * 50 + "c " * 7, "x y z " * 4, prose(3, 300)] + [prose(k, 5 + 7 * k, 9) for k in range(60)]
    ids = [*range(len(texts))]
    found = periodic_runs.digest(periodic_runs.with_runs(periodic_runs.looped(frame(texts, ids)).select("doc_id", "text")))
    for row in found.collect():
        w = _looped(row.doc_id, _words(texts[row.doc_id]))
        runs = _runs(w) if len(w) < 5000 else None
        if runs is None:
            continue
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        rest = " ".join(x for i, x in enumerate(w) if i not in dropped)
        assert row.n_runs == len(runs)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
    assert found.count() == len(texts)


def test_runs_keep_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a a a a a a", "r", "c"), (1, "a a a a a a", "r", "c"), (None, None, None, None)], "doc_id long, text string, runs string, collapsed string")
    rows = periodic_runs.with_runs(docs).collect()
    assert sorted((str(r.runs), len(r.runs_), r.collapsed_) for r in rows) == [("None", 0, ""), ("r", 1, "a"), ("r", 1, "a")]
    assert periodic_runs.digest(periodic_runs.with_runs(periodic_runs.looped(docs.select("doc_id", "text").limit(0)))).count() == 0
    assert len(periodic_runs.looped(docs).collect()) == 3


@pytest.fixture(scope="module")
def model():
    return pieces.encoder(pieces.model_path())


def test_ids_equal_the_library(model, odd_texts):
    r = random.Random(7)
    names = sorted(model.id)
    texts = [t or "" for t in odd_texts] + ["▁▁a ▁", "<s> <0x41> <unk>", "a\x00b", "  two  spaces   "]
    for _ in range(4000):
        kind = r.random()
        if kind < 0.4:
            texts.append("".join(r.choice(names) for _ in range(r.randint(1, 6))))
        elif kind < 0.6:
            texts.append("".join(r.choice([" ", "\n", "a", "ab", "-", "=", "▁"]) * r.randint(1, 9) for _ in range(r.randint(1, 6))))
        elif kind < 0.8:
            texts.append("".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0x10000, 0x10FFFF)])) for _ in range(9)))
        else:
            texts.append(prose(r.randint(0, 999), 12))
    for text, got in zip(texts, model.ids(texts)):
        assert got.tolist() == model.library.encode(text), text


def test_pairs_equal_the_library(model):
    """A pair is compatible if and only if the library leaves it as it is."""
    r = random.Random(3)
    for _ in range(5000):
        a, b = r.randrange(len(model.token)), r.randrange(len(model.token))
        (x, i), (y, j) = model.token[a], model.token[b]
        own = model.library.encode("\n" + x + y)[2:]  # the sign of the text's own beginning stays apart
        assert model.compatible(a, b) == (own == [i, j])


def test_small_memory_changes_nothing(model, monkeypatch):
    texts = [prose(k, 200) for k in range(20)]
    want = [x.tolist() for x in model.ids(texts)]
    monkeypatch.setattr(pieces, "PARTS", 10)
    monkeypatch.setattr(pieces, "PAIRS", 10)
    monkeypatch.setattr(pieces, "PART_CHARS", 4)
    assert [x.tolist() for t in texts for x in model.ids([t])] == want


def test_query_of_ids(spark, frame, model, odd_texts):
    docs = frame(odd_texts).withColumnRenamed("s", "ids")
    rows = pieces.digest(pieces.encoded(docs.drop("ids"), decoded="decoded")).collect()
    assert len(rows) == len(odd_texts)
    for row in rows:
        ids = model.library.encode(odd_texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((model.library.decode(ids) or "").encode()).hexdigest()
    clash = pieces.encoded(docs, decoded="size")
    assert clash.columns == [*docs.columns, "ids_", "size_"] and clash.filter("ids = 'x'").count() == len(odd_texts)
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_query_of_ids_on_the_given_table(spark, model):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in queries.op13_pieces(spark, SF).collect():
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, model.library.encode(texts[row.doc_id]))).encode()).hexdigest()


def _plain_whitening(vectors, most=16):
    """Deviations, shares and whitened values by a library's eigenvectors."""
    rows = [tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(rows))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    e, c = np.linalg.eigh(y.T @ y / n)
    keep = [k for k in np.argsort(-e)[:most] if e[k] > 1e-9 * e.max()]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in rows]
    w = (np.array([[n * c - s for c, s in zip(x, sums)] for x in rows], float) / n) @ c[:, keep] / np.sqrt(e[keep])
    return n, deviation, e[keep] / e.sum(), w


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def test_whitening_matches_eigenvectors(spark):
    r = np.random.default_rng(1)
    rows = (r.normal(size=(400, 24)) @ r.normal(size=(24, 24))).astype(np.float32).tolist()
    rows += rows[:3] * 50 + [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23]
    vectors = _vectors(spark, rows)
    model = whitening.fitted(vectors)
    got = {}
    for x in whitening.digest(whitening.whitened(vectors, model), model).collect():
        got.setdefault(x.vec_id, []).append(x)
    n, deviation, shares, w = _plain_whitening(rows[:550])
    assert sorted(got) == [*range(550)] and model.identity_error < 1e-9
    for i, own in got.items():
        own.sort(key=lambda x: x.component)
        assert [x.component for x in own] == [*range(1, 17)] and {(x.n, x.deviation) for x in own} == {(n, deviation[i])}
        assert np.allclose([x.explained for x in own], shares, rtol=1e-9)
    whole = np.array([[x.whitened for x in got[i]] for i in range(550)])
    signs = np.sign((whole * w).sum(axis=0))
    assert np.allclose(whole * signs, w, atol=1e-8)


def test_whitening_of_few_and_degenerate_vectors(spark):
    flat = [[float(a), 2.0 * a, 0.0] for a in range(5)] * 3
    vectors = _vectors(spark, flat)
    model = whitening.fitted(vectors)
    assert model.n == 5 and len(model.eigenvalues) == 1 and model.identity_error < 1e-9
    assert whitening.digest(whitening.whitened(vectors, model), model).count() == 15
    for rows in ([], [[1.0, 2.0]], [None, None]):
        model = whitening.fitted(_vectors(spark, rows))
        assert whitening.digest(whitening.whitened(_vectors(spark, rows), model), model).count() == 0
    mixed = _vectors(spark, [[1.0, 2.0], [3.0, 1.0], [1.0]])
    model = whitening.fitted(mixed)
    assert model.n == 2 and whitening.whitened(mixed, model).count() == 2
    large = _vectors(spark, [[2.0**30, 1.0], [-(2.0**30), 3.0], [0.0, 5.0]])
    model = whitening.fitted(large)
    n, deviation, shares, _ = _plain_whitening([[2.0**30, 1.0], [-(2.0**30), 3.0], [0.0, 5.0]])
    assert sorted(int(r.deviation) for r in whitening.whitened(large, model).collect()) == sorted(deviation) and np.allclose(model.eigenvalues / model.trace, shares, rtol=1e-4)
    clash = whitening.whitened(vectors.withColumn("whitened", vectors.vec_id), model=whitening.fitted(vectors))
    assert clash.columns[-2:] == ["whitened_", "deviation"]


def test_factor_and_rotations():
    r = np.random.default_rng(5)
    for n, rank in ((1, 1), (7, 7), (20, 6), (33, 33)):
        b = r.normal(size=(n, rank)) * np.logspace(0, -5, rank)
        v = b @ b.T
        factor, order = whitening.pivoted_cholesky(v)
        assert factor.shape[1] <= rank + 1 and np.allclose(factor @ factor.T, v[np.ix_(order, order)], atol=1e-12)
        values, rows = whitening.components_of(v)
        k = min(rank, len(values))
        assert np.allclose(values[:k], np.linalg.eigvalsh(v)[::-1][:k], rtol=1e-3) and np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-9)
    assert whitening.components_of(np.zeros((3, 3)))[0].size == 0
