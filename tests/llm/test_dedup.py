import hashlib
import re

import numpy as np
import xxhash

from spindrift.llm import exact_dedup, repeats, near_copies, simhash
from spindrift.llm.components import connected

from .conftest import prose


def _exact(texts, ids):
    norm = [re.sub(r"[\x20\x09-\x0D]+", "", t or "") for t in texts]
    out = []
    for i, s in zip(ids, norm):
        group = [(-len(t or ""), j is None, j or 0) for t, j, n in zip(texts, ids, norm) if n == s]
        _, null, best = min(group)
        out.append((i, None if null else best, len(group), hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_match_brute_force(frame, odd_texts):
    texts = odd_texts + ["ab c", "a bc", "abc", " abc ", prose(2, 900), prose(2, 900).replace(" ", "\n"), prose(2, 899)]
    ids = [None, *range(1, len(texts))]
    for options in ({}, {"hash_bits": 3, "shortest": 8, "longest": 32}):
        got = exact_dedup.exact_groups(frame(texts, ids), **options).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == _exact(texts, ids)
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_exact_groups_repeated_ids_and_empty(frame):
    got = exact_dedup.exact_groups(frame(["a b", "a b", "ab"], [7, 7, 7])).collect()
    assert [r.keep_id for r in got] == [7, 7, 7] and sum(r.kept for r in got) == 1
    assert exact_dedup.exact_groups(frame(["x"]).limit(0)).count() == 0


def _print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def _components(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return [least.get(x) for x in label]


def test_near_groups_match_brute_force(frame, odd_texts):
    base = prose(3, 400)
    near = [base.replace(w, "changed", 1) for w in base.split()[:30]]
    texts = odd_texts + near + [prose(k, 60) for k in range(10, 40)]
    ids = [None, *range(100, 99 + len(texts))]
    got = {(r.doc_id): (r.fingerprint, r.component_id) for r in simhash.near_groups(frame(texts, ids)).collect()}
    prints = [_print(t) for t in texts]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, _components(ids, prints))}
    assert got == want
    assert simhash.near_groups(frame(["x"]).limit(0)).count() == 0


def test_trie_join_finds_all_links_of_dense_groups(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.int64).astype(np.uint64)
    prints = []
    for c in centres:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    roots = connected(simhash.near_links(spark.createDataFrame(signed, "fingerprint long"))).collect()
    root = {r.node: r.root for r in roots}
    want = _components(list(range(len(prints))), prints)
    got = [root.get(s[0], s[0]) for s in signed]
    for i in range(len(prints)):
        for j in range(0, i, 7):
            assert (want[i] == want[j]) == (got[i] == got[j])


def test_one_of_each_keeps_columns_and_one_row(frame):
    docs = frame(["a b c d", "a b c d", "other words are here", None, ""], [2, 2, 3, 5, 4])
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_connected_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (5, 4)], "a long, b long")
    got = {r.node: r.root for r in connected(links).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]
    assert connected(links.limit(0)).count() == 0


def _repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_match_brute_force(frame):
    passage = prose(8, 60)
    texts = [None, "", "short", "ab" * 300, "a" * 250, "a" * 199, "xyz" * 100 + "q" * 10, "é" * 150]
    texts += [prose(k, 80) + f" {passage} " + prose(k + 50, 40) for k in range(20, 28)]
    texts += [prose(60, 200), prose(60, 200), prose(60, 150) + "!" + prose(60, 200)[600:]]
    for options in ({}, {"most_together": 1}, {"gram": 16, "block": 8}):
        got = repeats.repeats(frame(texts), **options).collect()
        assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _repeats(texts, 200)
    kept = repeats.repeats(frame(texts), keep_text=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in kept if r.kept is not None)
    assert repeats.repeats(frame(["x"]).limit(0)).count() == 0


def test_anchors_of_long_text_agree_across_pieces():
    text = (prose(9, 100_000) + " tail").encode()
    s, e, h, _ = repeats.anchors(text)
    assert s[0] == 0 and e[-1] == len(text) - 200 and (s[1:] == e[:-1] + 1).all()
    part = text[1_000:60_000]
    names = dict(zip(zip(s.tolist(), e.tolist()), h.tolist()))
    ps, pe, ph, _ = repeats.anchors(part)
    assert all(names.get((a + 1000, b + 1000)) == n for a, b, n in list(zip(ps.tolist(), pe.tolist(), ph.tolist()))[2:-2])
