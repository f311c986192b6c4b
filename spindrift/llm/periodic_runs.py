"""Runs of words that repeat with a period (loops of generated text), found by block convolution.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and at least
``max(LEAST, EXPONENT * q)`` words, which no neighbour extends. For periods from B to 2B - 1, B a power of two, the
words are cut into blocks of B. A run of such a period holds whole blocks that occur again ``q`` words on, in the 2B
words that follow them. Where they do is read from the sum of squared differences of block and window at each
distance, ``sum a^2 + sum t^2 - 2 sum a t``: the last term is a correlation, computed for all blocks at once by a
number-theoretic transform modulo as many primes as it takes to make a sum of zero certain. Distances at which
enough blocks in a row match are seeds, which are extended word by word to both sides.

Most blocks never reach the transform: each word of a block must come again within less than 2B words.
Everything is an array operation over many documents at a time; separators that occur once keep them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.llm.rows import unused
from spindrift.session import bound_batches

#: Fewest words of a run, and fewest repetitions of its period.
LEAST, EXPONENT = 6, 4
#: Primes below 2^31 with p - 1 divisible by 2^26, and a number that is no square modulo each (fixed values). They serve
#: periods below 2^25 words; longer ones need four times as many words in one document.
PRIMES = ((2013265921, 31), (1811939329, 13), (469762049, 3))
#: Words that are searched at once (a document is never split), and values in one transform.
PORTION, TRANSFORM = 1 << 20, 1 << 18

RUNS = T.ArrayType(T.StructType([T.StructField(k, T.LongType(), False) for k in ("start", "length", "period")]), False)


def transform(rows: np.ndarray, p: int, root: int) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two long), modulo ``p``, in bit-reversed order.

    ``root`` is a primitive root of unity of the rows' length. Decimation in frequency.
    """
    x, n = rows % p, rows.shape[1]
    while n > 1:
        half = n // 2
        v = x.reshape(-1, 2, half)
        a, b = v[:, 0], v[:, 1]
        x = np.stack(((a + b) % p, (a - b) % p * _powers(root, half, p) % p), axis=1).reshape(rows.shape)
        root, n = root * root % p, half
    return x


def inverse(rows: np.ndarray, p: int, root: int) -> np.ndarray:
    """The rows of which :func:`transform` gives these. Decimation in time."""
    x, n, size = rows, 2, rows.shape[1]
    while n <= size:
        half = n // 2
        v = x.reshape(-1, 2, half)
        a, b = v[:, 0], v[:, 1] * _powers(pow(root, (p - 1) - size // n, p), half, p) % p
        x = np.stack(((a + b) % p, (a - b) % p), axis=1).reshape(rows.shape)
        n *= 2
    return x * pow(size, -1, p) % p


def _powers(root: int, n: int, p: int) -> np.ndarray:
    """1, root, root^2, ... (n of them, a power of two)."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate((out, out * pow(root, len(out), p) % p))
    return out


def correlations(blocks: np.ndarray, windows: np.ndarray, p: int, g: int) -> np.ndarray:
    """``sum_i blocks[:, i] * windows[:, t + i]`` modulo ``p`` for t below the length of a block; windows are twice as long."""
    n = windows.shape[1]
    if (p - 1) % n:
        raise ValueError(f"a period of {n // 2} words or more in one document")
    root = pow(g, (p - 1) // n, p)
    reversed_ = np.zeros_like(windows)
    reversed_[:, 0] = blocks[:, 0]
    reversed_[:, n - blocks.shape[1] + 1 :] = blocks[:, :0:-1]
    return inverse(transform(reversed_, p, root) * transform(windows, p, root) % p, p, root)[:, : blocks.shape[1]]


def matches(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks of ``size`` words occur with no mismatch ``size`` to ``2 * size - 1`` words on: numbers in ``starts``, distances.

    Words past the end are none of any block's (id 0).
    """
    top = int(ids.max(initial=0))
    need, product = size * top * top + 1, 1
    used = []
    for p, g in PRIMES:
        if product < need:
            used.append((p, g))
            product *= p
    found = [], []
    per = max(1, TRANSFORM // (2 * size))
    padded = np.concatenate((ids, np.zeros(3 * size, np.int64)))
    for lo in range(0, len(starts), per):
        s = starts[lo : lo + per]
        a = padded[s[:, None] + np.arange(size)]
        t = padded[s[:, None] + np.arange(size, 3 * size)]
        zero = np.ones((len(s), size), bool)
        for p, g in used:
            sums = np.cumsum(np.pad(t * t % p, ((0, 0), (1, 0))), axis=1)
            squares = (a * a % p).sum(axis=1)[:, None] + sums[:, size : 2 * size] - sums[:, :size]
            zero &= (squares - 2 * correlations(a, t, p, g)) % p == 0
        at, d = np.nonzero(zero)
        found[0].append(at + lo)
        found[1].append(d + size)
    return (np.concatenate(found[0]), np.concatenate(found[1])) if found[0] else (np.zeros(0, np.int64),) * 2


def next_same(ids: np.ndarray) -> np.ndarray:
    """Distance from each place to the next with the same id; the length where there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _extended(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of places i with ``ids[i] == ids[i + d]`` grown from [lo, hi): by less than ``size`` to each side, where blocks differ."""
    n = len(ids)
    step = np.arange(size)
    out = np.empty_like(lo), np.empty_like(hi)
    per = max(1, TRANSFORM // size)
    for k in range(0, len(lo), per):
        part = slice(k, k + per)
        l, h, q = lo[part, None], hi[part, None], d[part, None]
        left, right = l - 1 - step, h + step
        same = (left >= 0) & (ids[np.maximum(left, 0)] == ids[np.maximum(left, 0) + q])
        out[0][part] = lo[part] - np.where(same.all(axis=1), size, same.argmin(axis=1))
        inside = right + q < n
        same = inside & (ids[np.where(inside, right, 0)] == ids[np.where(inside, right + q, 0)])
        out[1][part] = hi[part] + np.where(same.all(axis=1), size, same.argmin(axis=1))
    return out


def find_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs of a sequence of word ids, by start, then period. Ids that occur once never lie in a run."""
    n = len(words)
    none = np.zeros(0, np.int64)
    runs = none, none, none  # start, end, period
    if n < LEAST:
        return none, none, none
    _, kind, count = np.unique(words, return_inverse=True, return_counts=True)
    often = count >= EXPONENT
    small = np.where(often, np.cumsum(often), 0)[kind]  # words of runs come EXPONENT times at least
    reach = np.where(small > 0, next_same(small), n)
    size = 1
    while EXPONENT * size <= n and len(reach):
        blocks = len(reach)
        starts = np.flatnonzero(reach < 2 * size) * size
        if len(starts):
            # within a run of a smaller period, distances that stay in it give that run again
            order = np.argsort(runs[0], kind="stable")
            at = np.searchsorted(runs[0][order], starts, side="right")
            cover = np.concatenate(([0], np.maximum.accumulate(runs[1][order])))[at]
            todo = cover < starts + 3 * size - 1
            starts, cover = starts[todo], cover[todo]
            row, d = matches(small, starts, size)
            new = starts[row] + d + size > cover[row]
            block, d = starts[row[new]] // size, d[new]
            order = np.lexsort((block, d))
            block, d = block[order], d[order]
            first = np.ones(len(d), bool)
            first[1:] = (d[1:] != d[:-1]) | (block[1:] != block[:-1] + 1)
            begins = np.flatnonzero(first)
            chain = np.diff(np.append(begins, len(d)))
            lo, q = block[begins] * size, d[begins]
            # the stretch of equal words is a period shorter than the run and holds at least so many whole blocks
            least = np.maximum(LEAST, EXPONENT * q) - q
            long = chain >= np.maximum(1, (least + 1) // size - 1)
            lo, q, hi = lo[long], q[long], lo[long] + chain[long] * size
            lo, hi = _extended(words, lo, hi, q, size)
            long = hi - lo >= least[long]
            s, e, q = lo[long], hi[long] + q[long], q[long]
            start, end, period = (np.concatenate((r, x)) for r, x in zip(runs, (s, e, q)))
            order = np.lexsort((period, end, start))
            start, end, period = start[order], end[order], period[order]
            own = np.ones(len(start), bool)  # one stretch may be found with multiples of its period: the smallest is its own
            own[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
            runs = start[own], end[own], period[own]
        reach = np.maximum(reach[: blocks // 2 * 2 : 2], reach[1 : blocks // 2 * 2 : 2])
        size *= 2
    order = np.lexsort((runs[2], runs[0]))
    start, end, period = (r[order] for r in runs)
    return start, end - start, period


def _searched(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs and what is left of it without repetitions."""
    words = [t.split() for t in texts]  # bytes split at [\x20\x09-\x0D]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes + 1)
    flat: list[bytes | None] = []
    for w in words:
        flat += w
        flat.append(None)
    ids, _ = pd.factorize(np.array(flat, dtype=object))
    ids = ids.astype(np.int64)
    del flat
    gaps = ends - 1
    ids[gaps] = len(ids) + np.arange(len(gaps))  # each a word of its own
    start, length, period = find_runs(ids)
    doc = np.searchsorted(ends, start, side="right")
    lo, hi = np.searchsorted(doc, np.arange(len(words))), np.searchsorted(doc, np.arange(len(words)), side="right")
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    for k, w in enumerate(words):
        first = ends[k] - sizes[k] - 1
        if lo[k] == hi[k]:
            yield [], b" ".join(w)
            continue
        part = slice(lo[k], hi[k])
        found = [*zip((start[part] - first).tolist(), length[part].tolist(), period[part].tolist())]
        yield found, b" ".join([w[i] for i in np.flatnonzero(kept[first : ends[k] - 1]).tolist()])


def with_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs``, the runs of each text (``start, length, period`` in words ``[^\\x20\\x09-\\x0D]+``) and the text without repetitions.

    ``collapsed`` joins, by one space, the words that no run contains after its first period. Null and blank texts have
    no runs and an empty rest; each row stands for itself, so repeated rows come back repeated; an empty
    table gives no rows. The two columns get underscores where ``docs`` has columns of these names. A task holds about
    PORTION words at a time, or one document.
    """
    bound_batches(docs.sparkSession)
    runs, collapsed, raw = unused(docs.columns, runs, collapsed, "raw")
    schema = T.StructType([*docs.schema.fields, T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])
    n, names = len(docs.columns), [f.name for f in schema]
    kind = pa.list_(pa.struct([pa.field(k, pa.int64(), False) for k in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n).cast(pa.binary())
            lo, held = 0, 0
            for i in range(len(batch)):
                held += len(texts[i].as_py())
                if held >= 4 * PORTION or i == len(batch) - 1:
                    found, rest = zip(*_searched(texts.slice(lo, i + 1 - lo).to_pylist()))
                    own = batch.slice(lo, i + 1 - lo)
                    flat = [r for f in found for r in f]
                    cols = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
                    at = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))), pa.int32())
                    lists = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(cols, fields=[*kind.value_type]))
                    yield pa.RecordBatch.from_arrays([*own.columns[:n], lists, pa.array(rest, pa.binary()).cast(pa.string())], names=names)
                    lo, held = i + 1, 0

    return docs.withColumn(raw, F.coalesce(text_col, F.lit(""))).mapInArrow(run, schema)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which one row in ten was given a loop: where ``h = crc32(id)`` is a multiple of ten, words from place ``a`` on
    repeat with period ``p``; ``g = h / 10``, ``a = g % n``, ``p = 1 + (n - a) / (3 + g % 8)``. A null id or text is left alone."""
    words, g, n, a = unused(docs.columns, "words", "g", "n", "a")
    h = F.crc32(F.col(id_col).cast("string"))
    out = docs.withColumn(g, F.floor(h / 10)).withColumn(words, F.when(h % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    out = out.withColumn(n, F.size(words)).withColumn(a, (F.col(g) % F.greatest(F.col(n), F.lit(1))).cast("int"))
    p = F.expr(f"1 + (`{n}` - `{a}`) div (3 + `{g}` % 8)")
    place = lambda i: F.when(i < F.col(a), i).otherwise(F.col(a) + (i - F.col(a)) % p).cast("int")
    made = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.get(F.col(words), place(i)))
    return out.withColumn(text_col, F.when(F.col(n) > 0, F.array_join(made, " ")).otherwise(F.col(text_col))).drop(words, g, n, a)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``n_runs``, the run of the greatest exponent (ties: first start, then period), and hashes of the runs and of the rest."""
    better = lambda b, x: b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUNS.elementType), lambda b, x: F.when(better(b, x), x).otherwise(b))
    line = lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))
    out = found.select(id_col, "runs", "collapsed", best.alias("b"))
    return out.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *(F.col("b")[k].alias(k) for k in ("start", "length", "period")),
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
