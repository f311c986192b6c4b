"""Language ID by a linear-chain conditional random field over words.

Words carry affix, character n-gram and lexicon features (hashed); transitions between
the languages of neighbouring words are learned with them. Forward-backward gives each
word of a text its probabilities, so that a text may switch language; a document gets
the language with the highest mean. Training sees a bounded sample, prediction is a map
over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.session import bound_batches

#: The sample that the field is fitted on: documents (drawn by hash), spans of SPAN words of them (also drawn).
MAX_DOCS, MAX_SPANS, SPAN = 6_000, 8_000, 32
#: Slots of hashed features.
SLOTS = 1 << 18
#: Words whose emissions a task keeps, weights (words with padding, times languages) of one forward-backward run, bytes of text at a time.
_CACHE, _CELLS, _PORTION = 100_000, 2 << 20, 4 << 20
UNKNOWN = "und"


def letters_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The runs of letters of the whole texts, in lower case, and how many each text has (null: none)."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(texts.cast(pa.large_string())), r"\PL+", " ")
    lists = pc.split_pattern(pc.fill_null(spaced, ""), " ")
    words, offsets = lists.flatten(), lists.offsets.to_numpy()
    there = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
    return words.filter(there), np.diff(before[offsets - offsets[0]])


def _slot(kind: int, *codes: np.ndarray) -> np.ndarray:
    mixed = np.full(len(codes[0]), kind + 1, np.uint64)
    for c in codes:
        mixed = (mixed ^ c) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % SLOTS


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words' features, and of which word each is, in the order of the words.

    The word itself (lexicon), its prefixes and suffixes of one to three letters, and its
    bigrams and trigrams with the word's edges.
    """
    sizes = np.array([len(w) for w in words]) + 2
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    stops = np.cumsum(sizes)
    starts, owner = stops - sizes, np.repeat(np.arange(len(words)), sizes)
    left = stops[owner] - np.arange(len(codes))
    lexicon = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    slots, owners = [_slot(0, lexicon)], [np.arange(len(words))]
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        slots.append(_slot(n, *(codes[at + k] for k in range(n))))
        owners.append(owner[at])
    for n in (1, 2, 3):
        long = np.flatnonzero(sizes - 2 >= n)
        slots.append(_slot(10 + n, *(codes[starts[long] + 1 + k] for k in range(n))))
        slots.append(_slot(20 + n, *(codes[stops[long] - 2 - k] for k in range(n))))
        owners += [long, long]
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(slots)[order], np.concatenate(owners)[order]


def _emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Log-weights of each word for each language."""
    slots, owner = features(words)
    return np.add.reduceat(weights[slots], np.searchsorted(owner, np.arange(len(words))), axis=0)


@dataclass
class Field:
    """The fitted field: its languages, feature weights, transition and start weights."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def forward_backward(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray):
    """Posteriors of padded sequences (time, sequence, language), the longest first, and expected transitions."""
    steps, _, n = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    move, begin = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than t
    alpha = np.zeros_like(e)
    a = begin * e[0]
    alpha[0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, steps):
        k = live[t]
        a = (alpha[t - 1, :k] @ move) * e[t, :k]
        alpha[t, :k] = a / a.sum(axis=1, keepdims=True)
    post = alpha.copy()
    pairs = np.zeros((n, n))
    beta = np.ones(e.shape[1:])
    for t in range(steps - 1, 0, -1):
        k = live[t]
        b = e[t, :k] * beta[:k]
        both = alpha[t - 1, :k, :, None] * move * b[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += both.sum(axis=0)
        post[t - 1, :k] = both.sum(axis=2)
        back = b @ move.T
        beta[:k] = back / back.sum(axis=1, keepdims=True)
    return post, pairs


def train(spans: list[tuple[str, list[str]]], languages: list[str], epochs: int = 4, batch: int = 128, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Field:
    """Fit by AdaGrad on the likelihood of sequences of two spans each, of languages drawn at random.

    The joints teach the transitions what switching costs.
    """
    rng = np.random.default_rng(seed)
    n = len(languages)
    place = {x: i for i, x in enumerate(languages)}
    weights, transitions, start = np.zeros((SLOTS, n)), np.zeros((n, n)), np.zeros(n)
    g_w, g_t, g_s = np.full((SLOTS, n), 1e-8), np.full((n, n), 1e-8), np.full(n, 1e-8)
    names = sorted({w for _, ws in spans for w in ws})
    number = {w: i for i, w in enumerate(names)}
    all_slots, owner = features(names)
    bounds = np.searchsorted(owner, np.arange(len(names) + 1))
    coded = [(place[x], np.array([number[w] for w in ws])) for x, ws in spans]
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for lo in range(0, len(order), 2 * batch):
            mine = order[lo : lo + 2 * batch]
            seqs = []
            for i in range(0, len(mine), 2):
                parts = [coded[j] for j in mine[i : i + 2]]
                seqs.append((np.concatenate([np.full(len(w), y) for y, w in parts]), np.concatenate([w for _, w in parts])))
            seqs.sort(key=lambda s: -len(s[0]))
            lengths = np.array([len(s[0]) for s in seqs])
            words, back = np.unique(np.concatenate([s[1] for s in seqs]), return_inverse=True)
            sizes = bounds[words + 1] - bounds[words]
            first = np.cumsum(sizes) - sizes
            flat = all_slots[np.arange(sizes.sum()) + np.repeat(bounds[words] - first, sizes)]
            emit = np.add.reduceat(weights[flat], first, axis=0)
            seq = np.repeat(np.arange(len(seqs)), lengths)
            at = np.concatenate([np.arange(m) for m in lengths])
            scores = np.zeros((lengths[0], len(seqs), n))
            scores[at, seq] = emit[back]
            gold = np.concatenate([s[0] for s in seqs])
            post, pairs = forward_backward(scores, transitions, start, lengths)
            delta = post[at, seq]
            delta[np.arange(len(gold)), gold] -= 1
            per_word = np.stack([np.bincount(back, delta[:, c], len(words)) for c in range(n)], axis=1)
            used, where = np.unique(flat, return_inverse=True)
            spread = np.repeat(per_word, sizes, axis=0)
            grad = np.stack([np.bincount(where, spread[:, c], len(used)) for c in range(n)], axis=1) / len(seqs)
            grad += decay * weights[used]
            g_w[used] += grad**2
            weights[used] -= rate * grad / np.sqrt(g_w[used])
            seen = np.zeros((n, n))
            inner = seq[1:] == seq[:-1]
            np.add.at(seen, (gold[:-1][inner], gold[1:][inner]), 1)
            grad_t = (pairs - seen) / len(seqs)
            g_t += grad_t**2
            transitions -= rate * grad_t / np.sqrt(g_t)
            grad_s = (post[0].sum(axis=0) - np.bincount(gold[at == 0], minlength=n)) / len(seqs)
            g_s += grad_s**2
            start -= rate * grad_s / np.sqrt(g_s)
    return Field(languages, weights.astype(np.float32), transitions, start)


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, max_spans: int = MAX_SPANS, seed: int = 5) -> Field:
    """Fit on a sample of the rows with text and language whose id is not held out.

    About ``max_docs`` documents (more only if ids repeat) are cut into spans, and about
    ``max_spans`` different spans at most come to the driver; both are drawn by hash. Without
    such rows the field has no languages.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x"), F.col(lang_col).cast("string").alias("y"))
    usable = F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("i").isNotNull() & ~_held_out(F.col("i"))
    rows = rows.filter(usable)
    n = rows.select("y").count()
    draw = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30))
    rows = rows.filter(draw < int(min(1.0, max_docs / max(1, n)) * (1 << 30)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = letters_words(b.column(0))
            words, stop = words.to_numpy(zero_copy_only=False), np.cumsum(n)
            out = [
                (lang, " ".join(words[i : min(i + SPAN, hi)])) for lang, lo, hi in zip(b.column(1).to_pylist(), (stop - n).tolist(), stop.tolist()) for i in range(lo, hi, SPAN)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["y", "s"])

    cut = rows.select("x", "y").mapInArrow(spans, "y string, s string").distinct().persist()  # a sample: small
    share = min(1.0, max_spans / max(1, cut.count()))
    found = cut.filter(F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(1 << 30)) < int(share * (1 << 30))).collect()
    cut.unpersist()
    data = sorted((zlib.crc32(r["s"].encode()), r["y"], r["s"]) for r in found)
    languages = sorted({y for _, y, _ in data})
    if not languages:
        return Field([], np.zeros((1, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    return train([(y, s.split(" ")) for _, y, s in data], languages)


class _Predictor:
    def __init__(self, field: Field):
        self.field = field
        self.rows: dict[str, int] = {}
        self.emit = np.zeros((0, len(field.languages)), np.float32)

    def _emissions(self, words: list[str]) -> np.ndarray:
        """Of different words, each looked up if it was met not long ago."""
        if len(self.rows) > _CACHE:  # keep what is met again
            kept = [w for w in words if w in self.rows]
            self.emit = self.emit[[self.rows[w] for w in kept]]
            self.rows = dict(zip(kept, range(len(kept))))
        new = [w for w in words if w not in self.rows]
        self.rows.update(zip(new, range(len(self.emit), len(self.emit) + len(new))))
        self.emit = np.concatenate((self.emit, *(_emissions(new[i : i + 4096], self.field.weights) for i in range(0, len(new), 4096))))
        return self.emit[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        n = len(self.field.languages)
        words, sizes = letters_words(texts) if n else ([], [])
        if not len(words):
            return langs, scores
        coded = words.dictionary_encode()
        table = self._emissions(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        table = np.exp(table - table.max(axis=1, keepdims=True))
        codes, start = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + max(1, _CELLS // int(n * sizes[order[lo]])))
            group = order[lo:hi]
            lengths = sizes[group]
            seq = np.repeat(np.arange(len(group)), lengths)
            at = np.arange(len(seq)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            grid = np.zeros((lengths[0], n, len(group)), np.float32)
            grid[at, :, seq] = table[codes[start[group][seq] + at]]
            means = self._means(grid, lengths)
            for i, k, m in zip(group.tolist(), means.argmax(axis=0).tolist(), means.max(axis=0).tolist()):
                langs[i], scores[i] = self.field.languages[k], min(1.0, max(0.0, m))
            lo = hi
        return langs, scores

    def _means(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Mean posterior of each language from emissions (time, language, sequence), the largest of a word being 1.

        Like forward_backward, without the expected transitions. A step shrinks the sum of a
        column by the smallest transition at most, so that it need not be brought to 1 each time.
        """
        f = self.field
        steps, n, _ = e.shape
        move = np.exp(f.transitions - f.transitions.max()).astype(np.float32)
        begin = np.exp(f.start - f.start.max()).astype(np.float32)
        pause = max(1, int(12 / max(1.0, -np.log10(max(1e-30, float(min(move.min(), begin.min())))))))
        live = np.searchsorted(-lengths, -np.arange(steps), side="left").tolist()
        live[0] = len(lengths)
        alpha = np.empty_like(e)
        a = alpha[0] = begin[:, None] * e[0]
        for t in range(1, steps):
            k = live[t]
            a = move.T @ a[:, :k]
            a *= e[t, :, :k]
            if t % pause == 0:
                a /= a.sum(axis=0)
            alpha[t, :, :k] = a
        total = np.zeros(e.shape[1:])
        beta = np.ones(e.shape[1:], np.float32)
        for t in range(steps - 1, -1, -1):
            k = live[t]
            p = alpha[t, :, :k] * beta[:, :k]
            p /= np.maximum(p.sum(axis=0), 1e-37)
            total[:, :k] += p
            b = move @ (e[t, :, :k] * beta[:, :k])
            if t % pause == 0:
                b /= b.sum(axis=0)
            beta[:, :k] = b
        return total / lengths


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about _PORTION bytes: what is taken apart at a time."""
    stop = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = done = 0
    while lo < len(stop):
        hi = max(lo + 1, int(np.searchsorted(stop, done + _PORTION, side="right")))
        yield lo, hi
        lo, done = hi, int(stop[hi - 1])


def identify(docs: DataFrame, field: Field, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred, score`` (or other ``names``; columns of these names are replaced).

    A text that is null or has no letter, or any text under a field without languages, is
    ``und`` with score 0. Only the text is looked at. The broadcast field has a fixed number
    of slots, whatever the sample.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop(*names)
    columns = docs.columns
    at = columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _Predictor(shared.value)
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for lo, hi in _portions(batch.column(at)):
                a, b = predict(batch.column(at)[lo:hi])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *names]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``; the field learns from what is not held out.

    A null id is neither held out nor learned from. Repeated rows come back repeated; an
    empty table gives no rows; other columns are not read.
    """
    field = fit(docs, id_col, text_col, lang_col, **options)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = slim.withColumn("held_out", _held_out(F.col("doc_id")))
    return identify(slim, field).select("doc_id", "held_out", "lang_pred", "score")
