"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' normalised words in a task and sent to every task that scans; its
size is bounded, and a larger benchmark is dealt into several automata, each built by a task of its own. A document's
words stream through it, and the length of the longest match that ends at each word is tracked. Documents stay where
they are: there is no shuffle of them.
"""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.llm import rows as R
from spindrift.session import bound_batches, written

#: A window is so many consecutive words of an item; a shorter item is one window.
WINDOW = 10
#: One automaton takes items of about so many bytes of text and ids, and a pass over the documents so many automata. While it is built, a
#: mebibyte takes some 100 MB of the task that builds it; then about 12 MB of the driver and of each worker, and less where items are equal
#: or short, as each text is kept once. A benchmark of more than 16 MB takes more passes.
MAX_BYTES, PASS = 1 << 20, 16

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class _Ids(dict):
    def __missing__(self, _):
        return -1


class Automaton:
    """Suffix automaton of several word sequences, in arrays once it is built.

    Items of equal words are one sequence, and ``names`` holds the ids of each. ``windows[s]`` numbers
    the last WINDOW words of state ``s`` (0: it has fewer) and ``items_of`` gives the sequences in which
    those words occur. ``short[s]`` lists the sequences of fewer words (length, sequence) that end in
    ``s`` itself; ``ends[s]`` is the nearest such state on the way of suffix links that starts at ``s``
    (0: there is none), so that no state repeats what its suffixes hold.
    """

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, _Ids()
        self.next, self.link, self.len = [{}], [-1], [0]
        same: dict[tuple[int, ...], list[str]] = {}
        for name, words in items:
            same.setdefault(tuple(self.ids.setdefault(w, len(self.ids)) for w in words), []).append(name)
        seqs, self.names = list(same), list(same.values())
        pairs = {p for seq in seqs for p in zip(seq, seq[1:])}
        self.shortest = min([window, *(len(seq) for seq in seqs if seq)])
        for seq in seqs:
            state = 0
            for c in seq:
                state = self._extend(state, c)
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        windows = [0] * len(self.len)
        found: list[set[int]] = [set()]
        for s in order:
            if self.len[s] >= window:
                up = self.link[s]
                if self.len[up] < window:
                    found.append(set())
                windows[s] = windows[up] if self.len[up] >= window else len(found) - 1
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(seqs):  # once more through the automaton: which states the items' windows and ends are in
            state = 0
            for i, c in enumerate(seq, 1):
                state = self.next[state][c]
                if i >= window:
                    found[windows[state]].add(k)
            if 0 < len(seq) < window:
                self.short.setdefault(state, []).append((len(seq), k))
        self.ends = array("i", [0]) * len(self.len)
        for s in order:
            self.ends[s] = s if s in self.short else self.ends[self.link[s]]
        self.windows = array("i", windows)
        self.item_starts = array("i", np.cumsum([0, *map(len, found)]).tolist())
        self.item_list = array("i", [k for f in found for k in sorted(f)])
        steps = sorted((s << 32 | c, t) for s, following in enumerate(self.next) for c, t in following.items())
        self.steps, self.targets = array("Q", [k for k, _ in steps]), array("i", [t for _, t in steps])
        self.link, self.len, self.next = array("i", self.link), array("i", self.len), None
        # Which pairs of words may follow each other, as a bit map: a filter before the automaton.
        self.bits = max(16, (16 * len(pairs)).bit_length())
        self.follows = np.zeros(1 << self.bits, bool)
        if pairs:
            self.follows[self._slot(*np.array(sorted(pairs), np.uint64).T)] = True

    def items_of(self, window: int) -> array:
        return self.item_list[self.item_starts[window] : self.item_starts[window + 1]]

    def _step(self, state: int, c: int) -> int:
        """The state after ``c``, or -1."""
        key = state << 32 | c
        at = bisect_left(self.steps, key)
        return self.targets[at] if at < len(self.steps) and self.steps[at] == key else -1

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        return (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def _new(self, length: int, link: int, following: dict) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of ``q`` that end in those of ``p`` and ``c``."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, c: int) -> int:
        if c in self.next[p]:
            return self._split(p, c, self.next[p][c])
        new = self._new(self.len[p] + 1, 0, {})
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _runs(self, seq: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of known words in known succession that are long enough for a window."""
        known = seq >= 0
        least = self.shortest
        if least > 1:
            known = known[:-1] & known[1:]
            pair = seq.astype(np.uint64)
            known[known] = self.follows[self._slot(pair[:-1][known], pair[1:][known])]
            least -= 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], known.view(np.int8), [0]))))
        first, last = edge[::2], edge[1::2]
        long = last - first >= least
        return [(int(a), int(b) + (self.shortest > 1)) for a, b in zip(first[long], last[long])]

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal spans of words inside windows (end exclusive), and the sequences of those windows."""
        if len(words) < self.shortest:
            return [], set()
        seq = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        spans: list[list[int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        for start, stop in self._runs(seq):
            s = n = 0
            for i, c in enumerate(seq[start:stop].tolist(), start):
                while (to := self._step(s, c)) < 0 and s:
                    s = self.link[s]
                    n = self.len[s]
                if to >= 0:
                    s, n = to, n + 1
                hit = 0
                if n >= self.window:
                    hit = self.window
                    if (w := self.windows[s]) not in seen:
                        seen.add(w)
                        found.update(self.items_of(w))
                e = self.ends[s]
                while e:  # fewer than ``window`` sequences in all: suffixes of one match differ in length
                    for m, k in self.short[e]:
                        if m <= n:
                            hit = max(hit, m)
                            found.add(k)
                    e = self.ends[self.link[e]]
                if hit:
                    a = i + 1 - hit
                    while spans and spans[-1][0] >= a:
                        spans.pop()
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([a, i + 1])
        return [(a, b) for a, b in spans], found


def _automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[list[Automaton]]:
    """Automata of all items, each over at most about ``max_bytes`` of text and ids, PASS at a time.

    An item goes to the automaton of its hash, which a task builds and writes to the shared
    folder. The driver holds those of one pass.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("id") + F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-total // max_bytes))

    def build(key: tuple[int], mine: pd.DataFrame) -> pd.DataFrame:
        named = sorted((i, t or "") for i, t in zip(mine["id"], mine["text"]))
        return pd.DataFrame({"part": [key[0]], "automaton": [pickle.dumps(Automaton([(i, words_of(t)) for i, t in named], window))]})

    dealt = items.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)))
    built = written(dealt.groupBy("part").applyInPandas(build, "part long, automaton binary"), "op6-automata")
    for k in range(0, parts, PASS):
        if some := built.filter(F.col("part").between(k, k + PASS - 1)).orderBy("part").collect():
            yield [pickle.loads(r["automaton"]) for r in some]


_NAMES = ("n_words", "hit_spans", "hit_items")
_TYPES = (T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType()))


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_bytes: int = MAX_BYTES,
    names: tuple[str, str, str] = _NAMES,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words, hit_spans, hit_items`` (or other ``names``).

    ``hit_spans`` are the maximal spans of word numbers (start, end exclusive) inside any
    occurrence of a window of any item, ``hit_items`` the ids of those items, as strings in
    order (a null id: empty). Columns of ``docs`` by these three names are replaced.
    Null and empty texts have no words; items without words match nothing; repeated items
    and ids count once; empty tables give no hits or no rows.
    """
    return _passes(docs.drop(*names), benchmark, text_col, item_id, item_text, window, max_bytes, names)


def _passes(docs, benchmark, text_col, item_id, item_text, window, max_bytes, names, finish=None) -> DataFrame:
    """Each pass scans with some of the automata; ``finish`` maps the last one's batches, numbers of words and spans to batches of ``docs``."""
    bound_batches(docs.sparkSession)
    plain = docs.columns
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, _TYPES)])
    automata = _automata(benchmark, item_id, item_text, window, max_bytes)
    out, some = docs, next(automata, [Automaton([], window)])
    while some:
        shared, first, some = docs.sparkSession.sparkContext.broadcast(some), out is docs, next(automata, [])
        if not first:  # the automata of one pass in the tasks' memory
            out = written(out, "op6-part")
        last = finish is not None and not some
        out = out.mapInArrow(_scanner(shared, plain, names, text_col, first, finish if last else None), docs.schema if last else schema)
    return out


def _scanner(shared, plain: list[str], names: tuple[str, str, str], text_col: str, first: bool, finish):
    at = plain.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, items = [], [], []
            old = [None] * len(batch) if first else list(zip(batch.column(len(plain) + 1).to_pylist(), batch.column(len(plain) + 2).to_pylist()))
            for text, before in zip(batch.column(at).to_pylist(), old):
                words = words_of(text)
                hits = [list(map(tuple, before[0]))] if before else []
                hit = set(before[1]) if before else set()
                for automaton in shared.value:
                    s, k = automaton.matches(words)
                    hits.append(s)
                    hit.update(*(automaton.names[i] for i in k))
                n.append(len(words))
                spans.append([list(x) for x in (hits[0] if len(hits) == 1 else merged(sum(hits, [])))])
                items.append(sorted(hit))
            cols = [batch.column(i) for i in range(len(plain))]
            if finish:
                yield finish(pa.RecordBatch.from_arrays(cols, names=plain), n, spans)
                continue
            cols += [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*plain, *names])

    return scan


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_words(text: str, spans: list[list[int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_KEEP))]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", most_share: float = 0.5, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """The rows of ``docs`` with the benchmark's spans taken out of their text.

    Rows whose hit words are more than ``most_share`` of all their words are dropped. Rows without
    a hit come back unchanged, null and empty texts included, and so do all other columns, whatever their
    names. Repeated rows come back repeated; an empty table gives no rows, and an empty benchmark changes nothing.
    """
    at = docs.columns.index(text_col)

    def finish(batch: pa.RecordBatch, n: list[int], spans: list[list[list[int]]]) -> pa.RecordBatch:
        hit = [sum(b - a for a, b in s) for s in spans]
        if any(hit):
            texts = [without_words(t, s) if s else t for t, s in zip(batch.column(at).to_pylist(), spans)]
            batch = batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.column(at).type))
        return batch.filter(pa.array([h <= k * most_share for h, k in zip(hit, n)], pa.bool_()))

    return _passes(docs, benchmark, text_col, item_id, item_text, window, max_bytes, tuple(R.unused(docs.columns, *_NAMES)), finish)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of what find_items returns."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        F.col(id_col).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
