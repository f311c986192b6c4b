"""Removal of long byte strings that repeat anywhere in the corpus.

Every start of a LENGTH-byte string is a suffix to be told from all others by its first
LENGTH bytes. As in the merging of Burrows-Wheeler transforms by refinement, suffixes
begin in large classes and a round splits each class by more of their bytes; a suffix
whose class has one member is settled and takes no part in the next round. The classes
are named by hashes and counted by Spark, and consecutive suffixes that one anchor
names move as one interval, so that a round costs a shuffle of small rows:

1. the GRAM bytes of smallest hash inside the string (its anchor);
2. all bytes that the suffixes of one anchor span together;
3. the bytes that BLOCK neighbouring suffixes have in common, where round 2 left suffixes of an anchor apart;
4. the LENGTH bytes themselves, compared among the suffixes that round 3 left together.

Copies of whole documents are set aside first. The README says why no transform of the
whole corpus is built.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindrift.session import scratch, written

LENGTH, GRAM, BLOCK = 200, 32, 64
#: Blocks that may meet in one task of round 4; where more agree, their strings are counted by Spark one by one.
MOST_TOGETHER = 4096
#: Bytes looked at at a time.
_BYTES = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, _BYTES + LENGTH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BYTES + LENGTH + 1)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on, the same for the same bytes."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from minima of prefixes and suffixes of blocks."""
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], np.minimum.accumulate(full, axis=1).ravel()[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts of ``length``-byte strings: first, last, the hash of the anchor they share, and whether any
    two strings of the interval are equal.

    The anchor of a string is its ``gram`` bytes of smallest hash, so that equal strings have
    equal anchors. In text that repeats at a short distance an anchor comes several times in
    a string; such intervals are looked through here.
    """
    found: list[tuple[np.ndarray, ...]] = []
    width = length - gram + 1
    for lo in range(0, len(text) - length + 1, _BYTES):
        raw = np.frombuffer(text, np.uint8, min(len(text) - lo, _BYTES + length - 1), lo)
        h = _gram_hashes(raw, gram) & ~_LOW
        place = np.arange(len(h), dtype=np.uint64)
        left, right = _sliding_min(h | place, width), _sliding_min(h | (_LOW - place), width)
        name = right >> np.uint64(20)
        cut = np.flatnonzero(np.diff(name)) + 1
        first, last = np.append(0, cut), np.append(cut, len(name)) - 1
        own = (left[first] & _LOW) != _LOW - (right[last] & _LOW)  # the anchor comes at more than one place
        if own.any():
            whole = _gram_hashes(raw, length)
            for k in np.flatnonzero(own):
                part = whole[first[k] : last[k] + 1]
                own[k] = len(np.unique(part)) < len(part)
        found.append((first + lo, last + lo, name[first].view(np.int64), own))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                keys, texts = (b.column(k).slice(lo, 256) for k in (0, 1))
                found = [anchors(t.encode("utf-8", "surrogatepass"), length, gram) for t in texts.to_pylist()]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]), pa.int32())
                s, e, h, own = (np.concatenate([f[k] for f in found]) for k in range(4))
                cols = [keys.take(of), pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(own, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=["dk", "anchor", "s", "e", "own"])

    return run


def _two_longs(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(halves[:, 0]), pa.array(halves[:, 1])


def _interval_rows(length: int):
    """For each interval: a name for all bytes that its strings span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for b in batches:
            rows, names = [], []
            for key, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                for p in places:
                    rows.append((key, p["anchor"], p["s"], p["e"]))
                    names.append(digest(raw[p["s"] : p["e"] + length]))
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*cols, *_two_longs(names)], names=["dk", "anchor", "s", "e", "n1", "n2"])

    return run


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    for part in np.split(starts, np.flatnonzero(np.diff(starts) != 1) + 1):
        if len(part):
            yield int(part[0]), int(part[-1])


def _names(raw: bytes, first: int, last: int, length: int) -> list[bytes]:
    from xxhash import xxh3_128_digest as digest

    return [digest(raw[i : i + length]) for i in range(first, last + 1)]


def _equal(names: list[bytes]) -> np.ndarray:
    """Which of the names come more than once."""
    n = Counter(names)
    return np.fromiter((n[x] > 1 for x in names), bool, len(names))


def _marks(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["dk", "s", "e"])


def _own_rows(length: int):
    """Runs of starts whose strings come twice within their own interval."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                for p in places:
                    twice = _equal(_names(raw, p["s"], p["e"], length))
                    rows += [(key, i, j) for i, j in _runs(np.flatnonzero(twice) + p["s"])]
            yield _marks(rows)

    return run


def _block_rows(length: int, gram: int, block: int):
    """The intervals cut at every ``block`` starts, counted from the anchor, with a name for the bytes that a whole block
    shares and one for all its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for b in batches:
            rows, names, wholes = [], [], []
            for key, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                for s, e in _pieces([(p["s"], p["e"]) for p in places]):
                    h = _gram_hashes(np.frombuffer(raw, np.uint8, e - s + length, s), gram) & ~_LOW
                    right = _sliding_min(h | (_LOW - np.arange(len(h), dtype=np.uint64)), length - gram + 1)
                    at = (_LOW - (right & _LOW)).astype(np.int64)
                    number = (at - np.arange(len(at))) // block
                    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(number) != 0)) + 1
                    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
                        end = s + int(at[i] - block * number[i])  # the last start of the whole block
                        rows.append((key, s + i, s + j - 1))
                        names.append(digest(raw[end : end - block + 1 + length]))
                        wholes.append(digest(raw[s + i : s + j - 1 + length]))
            cols = [*_marks(rows).columns, *_two_longs(names), *_two_longs(wholes)]
            yield pa.RecordBatch.from_arrays(cols, names=["dk", "s", "e", "n1", "n2", "w1", "w2"])

    return run


def _pieces(intervals: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Intervals in pieces of bounded length."""
    for s, e in intervals:
        for i in range(s, e + 1, _BYTES):
            yield i, min(e, i + _BYTES - 1)


def _bytes_rows(length: int):
    """The blocks with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(key, p["s"], raw[p["s"] : p["e"] + length], p["n1"], p["n2"]) for p in places]
            types = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["dk", "s", "raw", "n1", "n2"])

    return run


def _compared_rows(length: int):
    """Runs of starts whose strings come twice among the blocks of one name; the rows come ordered by name."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        names = [n for r in rows for n in _names(r[2], 0, len(r[2]) - length, length)]
        twice, at, out = _equal(names), 0, []
        for key, s, raw, _, _ in rows:
            n = len(raw) - length + 1
            out += [(key, i, j) for i, j in _runs(np.flatnonzero(twice[at : at + n]) + s)]
            at += n
        return _marks(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(held) >= 4096 and row[3:] != held[-1][3:]:
                    yield found(held)
                    held = []
                held.append(row)
        if held:
            yield found(held)

    return run


def _string_rows(length: int):
    """For each start in the intervals: a name for the ``length`` bytes from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for b in batches:
            for lo in range(0, len(b), 16):
                part = b.slice(lo, 16)
                keys, starts, names = [], [], []
                for key, text, places in zip(*(part.column(k).to_pylist() for k in range(3))):
                    raw = text.encode("utf-8", "surrogatepass")
                    for p in places:
                        here = range(p["s"], p["e"] + 1)
                        starts += here
                        names += [digest(raw[i : i + length]) for i in here]
                        keys += [key] * len(here)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), *_two_longs(names)], names=["dk", "s", "n1", "n2"]
                )

    return run


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes and runs removed, and what is left, for spans (start, end exclusive) in any order."""
    left, at, gone, runs = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            runs += 1
            left.append(raw[at:a])
        gone += max(0, b - max(a, end))
        end = at = max(end, b)
    return gone, runs, b"".join([*left, raw[at:]])


def _cut_rows(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, text, places in zip(*(b.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                gone, runs, left = cut_out(raw, [(p["s"], p["e"] + length) for p in places])
                out.append((key, gone, runs, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["dk", "n_removed", "n_spans", "kept_sha256", "kept"]
            )

    return run


@contextmanager
def _distinct_texts(docs: DataFrame, folder: str) -> Iterator[DataFrame]:
    """``dk, text, copies`` of the distinct texts, bucketed by ``dk``: later joins by ``dk`` don't move texts. The table is there inside only."""
    spark = docs.sparkSession
    name = f"spindrift_texts_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.groupBy("dk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    try:
        texts.write.format("parquet").option("path", f"{folder}/texts").option("compression", "zstd").bucketBy(buckets, "dk").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _results(texts: DataFrame, length: int, gram: int, block: int, most_together: int, keep_text: bool) -> DataFrame:
    """``r_dk, n_removed, n_spans, kept_sha256, kept`` of the texts that lose something (``n_removed`` -1: all), and of others that were looked at."""
    # Round 1: anchors that occur once name strings that occur once.
    rows = texts.filter(F.octet_length("text") >= length).select("dk", "text").mapInArrow(
        _anchor_rows(length, gram), "dk binary, anchor long, s long, e long, own boolean"
    )
    shared = written(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "op9-shared")
    met = rows.join(shared.withColumn("met", F.lit(True)), "anchor", "left").filter("met or own")
    places = written(met.select("dk", "anchor", "s", "e", "own"), "op9-places")

    def with_text(found: DataFrame, *cols: str) -> DataFrame:
        return texts.select("dk", "text").join(found.groupBy("dk").agg(F.collect_list(F.struct(*cols)).alias("places")), "dk").select("dk", "text", "places")

    # Round 2: intervals whose strings span the same bytes hold the same strings.
    named = written(
        with_text(places, "anchor", "s", "e").mapInArrow(_interval_rows(length), "dk binary, anchor long, s long, e long, n1 long, n2 long"),
        "op9-intervals",
    )
    classes = written(
        named.groupBy("anchor", "n1", "n2").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s", "e")).alias("one")), "op9-classes"
    )
    same = classes.filter("n > 1").select("anchor", "n1", "n2")
    whole = named.join(written(same, "op9-same"), ["anchor", "n1", "n2"], "left_semi").select("dk", "s", "e")

    # Round 3: where an anchor has several classes, one interval of each class, in blocks; of equal blocks, one goes on.
    apart = written(classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor"), "op9-apart")
    open_ = written(classes.join(apart, "anchor", "left_semi").select("one.*"), "op9-open")
    blocks = written(
        with_text(open_, "s", "e").mapInArrow(
            _block_rows(length, gram, block), "dk binary, s long, e long, n1 long, n2 long, w1 long, w2 long"
        ),
        "op9-blocks",
    )
    kinds = written(
        blocks.groupBy("n1", "n2", "w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("dk", "s", "e")).alias("one")), "op9-kinds"
    )
    same = written(kinds.filter("n > 1").select("n1", "n2", "w1", "w2"), "op9-same-blocks")
    whole = whole.union(blocks.join(same, ["n1", "n2", "w1", "w2"], "left_semi").select("dk", "s", "e"))
    met = written(kinds.groupBy("n1", "n2").agg(F.count("*").alias("m")).filter("m > 1"), "op9-met")
    blocks = written(kinds.join(met, ["n1", "n2"]).select("n1", "n2", "m", "one.*"), "op9-together")

    # Round 4: their strings.
    few = with_text(blocks.filter(F.col("m") <= most_together), "s", "e", "n1", "n2").mapInArrow(
        _bytes_rows(length), "dk binary, s long, raw binary, n1 long, n2 long"
    )
    few = few.repartition("n1", "n2").sortWithinPartitions("n1", "n2").mapInArrow(_compared_rows(length), "dk binary, s long, e long")
    own = with_text(places.filter("own"), "s", "e").mapInArrow(_own_rows(length), "dk binary, s long, e long")
    marks = whole.union(few).union(own)
    many = blocks.filter(F.col("m") > most_together)
    if not many.isEmpty():
        strings = written(with_text(many, "s", "e").mapInArrow(_string_rows(length), "dk binary, s long, n1 long, n2 long"), "op9-strings")
        twice = written(strings.groupBy("n1", "n2").agg(F.count("*").alias("n")).filter("n > 1").select("n1", "n2"), "op9-twice")
        marks = marks.union(strings.join(twice, ["n1", "n2"], "left_semi").select("dk", "s", F.col("s").alias("e")))
    marks = written(marks, "op9-marks")
    cut = with_text(marks, "s", "e").mapInArrow(
        _cut_rows(length, keep_text), "dk binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    copied = texts.filter((F.col("copies") > 1) & (F.octet_length("text") >= length)).select("dk")
    cut = written(cut.join(copied, "dk", "left_anti"), "op9-cut")
    nothing = F.lit(b"") if keep_text else F.lit(None).cast("binary")
    gone = copied.select("dk", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), nothing.alias("kept"))
    return written(cut.union(gone).withColumnRenamed("dk", "r_dk"), "op9-results", keep=True)


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK,
    most_together: int = MOST_TOGETHER, keep_text: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, bytes, if asked for).

    Removed is every byte inside a ``length``-byte string of UTF-8 that also starts at another
    place of any text, the same one included; places are judged on the texts as given.
    Null text is empty; texts shorter than ``length`` lose nothing; every long text that occurs
    twice loses all. Repeated rows come back repeated; other columns are not read; an empty
    table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("sha", F.sha2("text", 256)).withColumn("dk", F.unhex(F.substring("sha", 1, 32)))
    slim = written(base.select("doc_id", "dk", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "op9-docs", keep=True)
    with scratch(docs.sparkSession, "op9") as folder, _distinct_texts(base.select("dk", "text"), folder) as texts:
        results = _results(texts, length, gram, block, most_together, keep_text)

    n_removed = F.when(F.col("n_removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    out = slim.join(results, F.col("dk") == F.col("r_dk"), "left").select(
        "doc_id", "n_bytes", n_removed.cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept"
    )
    return out if keep_text else out.drop("kept")
