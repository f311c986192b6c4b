"""SimHash near-dedup: 64-bit fingerprints, joined with themselves as binary tries.

Two fingerprints that differ in at most three bits differ in at most one bit of their
first or of their second half. So there are two tries, one that reads the bits in order
and one that starts with the second half; in each, pairs of nodes may have spent one
error in the first 32 levels and three in all. The upper levels are traversed by Spark:
a fingerprint goes to the task of its own prefix, and to those of the prefixes that
differ in one bit that it has clear. The lower levels are traversed within tasks, on
sorted arrays. A task reports a spanning forest of the links it finds, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.llm.components import connected
from spindrift.session import bound_batches, written

SHINGLE, SEED, BITS = 3, 42, 64
#: Differing bits allowed in all, and in the half that a trie starts with.
ERRORS, FIRST_HALF_ERRORS = 3, 1
#: Fingerprints of one prefix, about, and rows of one task.
PREFIX_ROWS, TASK_ROWS = 64, 200_000
#: Pairs of leaves compared at once, and pairs of nodes expanded at once.
_LEAF, _CHUNK = 64, 1 << 17

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 hashes of the text's word shingles; no words: zero."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        return h(b" ".join(words), SEED)
    if size == 3:
        hashes = [h(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    else:
        hashes = [h(b" ".join(words[i : i + size]), SEED) for i in range(len(words) - size + 1)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; of none, zero."""
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((raw + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """All rows and columns of ``docs`` and the fingerprint as a signed long (a column of that name is replaced)."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(name)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict = {}  # copies lie together often enough
            out = []
            for text in batch.column(at).to_pylist():
                if text not in known:
                    known[text] = fingerprint(text, size)
                out.append(known[text])
            prints = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*columns, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


class _Links:
    """Union-find over the rows of a task, with arrays that tell whether a range is one component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.label[u], self.label[v]
            if not (apart := a != b).any():
                return changed
            changed = True
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
            self.label = parent[self.label]


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and of which range each is."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def trie_join(
    x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, value: np.ndarray, links: _Links, depth: int, spent: int,
    errors: int = ERRORS, half_errors: int = FIRST_HALF_ERRORS,
) -> None:
    """Traverse two tries together from ``depth`` down, where ``spent`` errors have been made, and join what is near.

    ``x`` and ``y`` are the sorted bit strings (the same array: a self-join) and ``xi, yi``
    the rows of ``value``, the fingerprints, that they stand for. Pairs of nodes that are
    in one component already are not followed.
    """
    own = x is y
    shift = np.uint64(BITS - depth)
    top = lambda a: np.zeros(len(a), np.uint64) if depth == 0 else a >> shift
    keys, start = np.unique(top(x), return_index=True)
    stop = np.append(start[1:], len(x))
    if own:
        pairs = np.stack([start, stop, start, stop])
    else:
        keys_y, start_y = np.unique(top(y), return_index=True)
        stop_y = np.append(start_y[1:], len(y))
        _, a, b = np.intersect1d(keys, keys_y, assume_unique=True, return_indices=True)
        pairs = np.stack([start[a], stop[a], start_y[b], stop_y[b]])
    todo = [(depth, pairs, np.full(pairs.shape[1], spent))]
    change_x = change_y = None
    while todo:
        depth, pairs, err = todo.pop()
        if pairs.shape[1] > _CHUNK:
            todo.append((depth, pairs[:, _CHUNK:], err[_CHUNK:]))
            pairs, err = pairs[:, :_CHUNK], err[:_CHUNK]
        if change_x is None:
            change_x = np.append(0, np.cumsum(np.diff(links.label[xi]) != 0)) if len(xi) else np.zeros(1, int)
            change_y = np.append(0, np.cumsum(np.diff(links.label[yi]) != 0)) if len(yi) else np.zeros(1, int)
        xl, xh, yl, yh = pairs
        joined = (change_x[xh - 1] == change_x[xl]) & (change_y[yh - 1] == change_y[yl]) & (links.label[xi[xl]] == links.label[yi[yl]])
        pairs, err = pairs[:, ~joined], err[~joined]
        if not pairs.shape[1]:
            continue
        xl, xh, yl, yh = pairs
        small = ((xh - xl) * (yh - yl) <= _LEAF) | (depth == BITS)
        if small.any():
            sl, sh, tl, th = pairs[:, small]
            left, which = _ranges(sl, sh)
            right, of = _ranges(tl[which], th[which])
            u, v = xi[left[of]], yi[right]
            near = np.bitwise_count(value[u] ^ value[v]) <= errors
            if links.join(u[near], v[near]):
                change_x = change_y = None
            pairs, err = pairs[:, ~small], err[~small]
            if not pairs.shape[1]:
                continue
            xl, xh, yl, yh = pairs
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        mask = ~(bit | (bit - np.uint64(1)))
        xm = np.searchsorted(x, (x[xl] & mask) | bit)
        ym = xm if own and (xl == yl).all() else np.searchsorted(y, (y[yl] & mask) | bit)
        budget = half_errors if depth < BITS // 2 else errors
        for cross in (True, False):  # the last is done first: near nodes before far ones
            for one in (False, True):
                child = np.stack([xm if one else xl, xh if one else xm, ym if one ^ cross else yl, yh if one ^ cross else ym])
                good = (child[0] < child[1]) & (child[2] < child[3]) & (err + cross <= budget)
                if own and cross and one:
                    good &= xl != yl  # of a node and itself, the two halves meet once
                if good.any():
                    todo.append((depth + 1, child[:, good], err[good] + cross))


def _forest(batches: Iterator[pa.RecordBatch], prefix: int) -> Iterator[pa.RecordBatch]:
    """Links found among the rows of a partition: ``turn, placed, fingerprint``."""
    tables = [b for b in batches if len(b)]
    if not tables:
        return
    turn, placed, prints = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in tables]) for k in range(3))
    placed, prints = placed.view(np.uint64), prints.view(np.uint64)
    value, row = np.unique(prints, return_inverse=True)
    links = _Links(len(value))
    for t in (0, 1):
        own = np.flatnonzero(turn == t)
        shown = value[row[own]]
        turned = (shown << np.uint64(32)) | (shown >> np.uint64(32)) if t else shown
        native = placed[own] == turned
        sides = []
        for side in (native, ~native):
            order = np.argsort(placed[own][side], kind="stable")
            sides += [placed[own][side][order], row[own][side][order]]
        x, xi, y, yi = sides
        if len(x):
            trie_join(x, xi, x, xi, value, links, prefix, 0)
        if len(x) and len(y):
            trie_join(x, xi, y, yi, value, links, prefix, 1)
    moved = np.flatnonzero(links.label != np.arange(len(value)))
    if len(moved):
        ends = (value[moved].view(np.int64), value[links.label[moved]].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])


def near_links(prints: DataFrame, col: str = "fingerprint") -> DataFrame:
    """Links ``a, b`` that connect exactly the distinct fingerprints of ``prints`` that lie within three bits of each other.

    Not all pairs: a spanning forest of each task's, so that their number follows the
    number of fingerprints however dense a group is.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = written(prints.select(F.col(col).alias("f")).distinct().repartition(tasks), "op2-distinct")  # a row becomes many
    n = distinct.count()
    prefix = min(BITS // 2, max(0, (n // PREFIX_ROWS).bit_length()))
    turned = F.shiftleft("f", 32).bitwiseOR(F.shiftrightunsigned("f", 32))
    rows = distinct.select("f", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("f").alias("x")), F.struct(F.lit(1).alias("turn"), turned.alias("x")))).alias("t"))
    rows = rows.select("f", "t.turn", "t.x")
    if prefix:
        levels = F.array(*[F.lit(_signed(1 << (BITS - 1 - j))) for j in range(prefix)])
        clear = F.filter(levels, lambda b: F.col("x").bitwiseAND(b) == 0)
        places = F.concat(F.array("x"), F.transform(clear, lambda b: F.col("x").bitwiseOR(b)))
        rows = rows.select("f", "turn", F.explode(places).alias("placed"))
        key = F.shiftrightunsigned("placed", BITS - prefix)
        tasks = max(tasks, -(-n * (2 + prefix) // TASK_ROWS))
        rows = rows.withColumn("key", key).repartition(tasks, "turn", "key")
    else:
        rows = rows.withColumn("placed", F.col("x")).repartition(1)
    return rows.select("turn", "placed", "f").mapInArrow(lambda it: _forest(it, prefix), "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` (a written table with ``doc_id, fingerprint``) and ``component_id``."""
    small = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "op2-least")
    roots = written(connected(near_links(rows), "op2-links").select(F.col("node").alias("fingerprint"), "root"), "op2-roots")
    linked = written(small.join(roots, "fingerprint"), "op2-linked")
    least = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "op2-components")
    of = linked.join(least, "root").select("fingerprint", "component_id")
    alone = small.join(roots, "fingerprint", "left_anti").select("fingerprint", F.col("least").alias("component_id"))
    names = written(of.union(alone).withColumnRenamed("fingerprint", "f"), "op2-names")
    return rows.join(names, F.col("fingerprint") == F.col("f")).drop("f")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest id that can
    be reached over fingerprints that differ in three bits or fewer. Null and empty texts
    have fingerprint zero and are linked like any other. Null ids count for no minimum (a
    component of null ids only has a null id). Repeated rows come back repeated; other
    columns are not read; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(with_fingerprints(slim, "text", size).select("doc_id", "fingerprint"), "op2-rows")
    named = labelled(rows)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
