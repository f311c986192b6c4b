import random

import corpus_pipeline
from spindrift.llm import near_copies

from .conftest import prose


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def _kept(texts):
    """Smallest place of each group, by brute force."""
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return sorted(set(label))


def _changed(text, seed, n):
    r, words = random.Random(seed), text.split()
    at = r.randint(0, len(words) - n)  # a run of n words costs n + 4 shingles
    words[at : at + n] = [f"new{seed}x{k}" for k in range(n)]
    return " ".join(words)


def test_near_dedup_stage_finds_planted_copies(spark, frame, tmp_path):
    texts = [prose(k, 200) for k in range(30)]
    texts += [_changed(texts[k], 100 + k, 14) for k in range(30)]  # similarity 0.83
    texts += [_changed(texts[k], 200 + k, 30) for k in range(10)]  # 0.70: stay
    kept = corpus_pipeline.drop_near_copies(spark, frame(texts), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == _kept(texts) == [*range(30), *range(60, 70)]


def test_near_copies_match_brute_force(frame, odd_texts, monkeypatch):
    base = prose(3, 300)
    texts = odd_texts + [_changed(base, k, 1 + k % 40) for k in range(60)] + ["a b c d", "A b  c d", "a b c d e f"]
    texts += [prose(4, 40) + " " + prose(k, 45) for k in range(50, 70)]  # a shared passage, no copies
    ids = [*range(len(texts))]
    for leaders in (near_copies.LEADERS, 1):
        monkeypatch.setattr(near_copies, "LEADERS", leaders)
        docs = frame(texts, ids)
        kept = near_copies.one_of_each(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == _kept(texts)
    assert near_copies.one_of_each(frame(["x"]).limit(0)).count() == 0
    assert len(near_copies.one_of_each(frame(["x y", "x y", None], [None, 2, None])).collect()) == 2
