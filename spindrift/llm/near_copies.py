"""SimHash near-dedup at a similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of the shingles are joined by the trie self-join of :mod:`simhash`, within its
three bits. That finds the closest copies; at 0.8 fingerprints differ in about 10 of 64 bits,
and a budget that finds such pairs (some 17 bits) also meets about one in 6,000 of all
unrelated pairs, so that the join would grow with the square of the table. The rest of the candidates
come from bands of min-hashes, which unrelated texts do not share, and have to lie within
a wide Hamming budget. Every candidate, of either kind, is checked on the sets themselves.
Copies with equal sets are one node from the start. In each round some nodes of a band's
bucket outside its largest component, its leaders, meet the others, and it is done when it is one
component. What is joined already is not compared, and rows stand for nodes and never for pairs: near copies take few
comparisons, but texts of a bucket that are near none of its others are compared with all of them in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindrift.llm import rows as R, simhash
from spindrift.llm.components import connected
from spindrift.session import bound_batches, scratch, written

SHINGLE, SEED = 5, 42
#: A pair is near if intersection / union is at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
#: Min-hashes in bands: a pair of similarity 0.8 shares no band with probability (1 - 0.8**5)**20 = 0.0004.
BANDS, ROWS = 20, 5
#: Differing bits of fingerprints beyond which a pair that shares a band is not looked at. At 0.8 it is about 10 with a deviation of
#: 3, for the shortest sets (4 of 5 shingles) 12.
WIDE = 26
#: Nodes of a bucket that meet its others in the first round, about, how that grows from round to round, and up to what.
LEADERS, MORE, MOST_LEADERS = 4, 4, 512
#: Rows of a bucket that one task compares with its leaders, about.
PART_ROWS = 512
_ALL = (1 << 64) - 1
_PIECE = 4096
_P = np.uint64(0x9E3779B97F4A7C15)
_MASKS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _FACTORS | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles; of a shorter text, one of all its words."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array([h(w, SEED) for w in words], np.uint64)
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _P + hashes[k : k + n]
    return np.unique(_mix(out))


def bands(s: np.ndarray) -> np.ndarray:
    """One signed long a band; none for an empty set."""
    if not len(s):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), _PIECE):
        np.minimum(least, ((s[i : i + _PIECE] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in _mix(least).reshape(BANDS, ROWS).T:
        key = _mix(key * _P + column)
    return key.view(np.int64)


_SKETCH = [
    T.StructField("set_key", T.BinaryType()),
    T.StructField("n", T.LongType()),
    T.StructField("print", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
]


def _sketched(rows: DataFrame) -> DataFrame:
    """``rows`` with ``set_key`` (128 bits that stand for the set), its size ``n``, fingerprint and bands in place of the text, the last column."""
    columns = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingles(t) for t in batch.column(len(columns)).to_pylist()]
            keys = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
            found = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], keys, sizes, prints, found], names=[*columns, *(f.name for f in _SKETCH)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *_SKETCH]))


_MEMBERS = T.StructType([T.StructField("node", T.LongType()), T.StructField("members", T.BinaryType())])


def _sets(b: pa.RecordBatch) -> pa.RecordBatch:
    sets = pa.array([shingles(t).tobytes() for t in b.column(0).to_pylist()], pa.binary())
    return pa.RecordBatch.from_arrays([b.column(1), sets], names=_MEMBERS.names)


def _is_near(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    every = np.concatenate((s, t))
    every.sort(kind="stable")  # merges the two
    both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both * NEAR[1] >= (len(every) - both) * NEAR[0]


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ``a, b, x, y`` (components and sets of two nodes) the components of those that are near."""
    for batch in batches:
        good = [_is_near(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) for pair in zip(batch.column(2), batch.column(3))]
        found = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], names=["a", "b"])


def _possible(n: Column, m: Column, p: Column, q: Column) -> Column:
    """Whether sets of sizes ``n, m`` and fingerprints ``p, q`` may be near."""
    return (F.least(n, m) * NEAR[1] >= F.greatest(n, m) * NEAR[0]) & (F.bit_count(p.bitwiseXOR(q)) <= WIDE)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` of the pairs ``p, a, q, b`` (nodes and their components) that are near.

    Sets are joined by a shuffle at every size: pairs grow with the table, and are not for a broadcast.
    """
    sets = sets.hint("merge")
    left = written(pairs.join(sets, F.col("p") == F.col("node")).select("a", "b", "q", F.col("members").alias("x")), "near-left")
    both = left.join(sets, F.col("q") == F.col("node")).select("a", "b", "x", F.col("members").alias("y"))
    return written(both.mapInArrow(_near, "a long, b long"), "near-links")


def _by_prints(nodes: DataFrame) -> DataFrame:
    """Pairs ``p, q`` of nodes that the trie self-join links: of equal fingerprints with the least, and the least ones of linked fingerprints."""
    least = written(nodes.groupBy("print").agg(F.min(F.struct("node", "n")).alias("m")).select("print", "m.*"), "near-prints")
    links = written(simhash.near_links(least, "print"), "near-trie")
    u = least.select(F.col("print").alias("a"), F.col("node").alias("p"), F.col("n").alias("n_p"))
    v = least.select(F.col("print").alias("b"), F.col("node").alias("q"), F.col("n").alias("n_q"))
    own = nodes.select(F.col("print").alias("a"), F.col("node").alias("q"), F.col("n").alias("n_q")).join(u, "a").filter("p <> q")
    far = links.join(u, "a").join(v, "b")
    pairs = own.select("p", "q", "n_p", "n_q").union(far.select("p", "q", "n_p", "n_q"))
    return pairs.filter(_possible(F.col("n_p"), F.col("n_q"), F.lit(0), F.lit(0))).select("p", "q")


def _joined(live: DataFrame, links: DataFrame) -> DataFrame:
    """``live`` with each component under its name after the links."""
    if links.isEmpty():
        return live
    roots = written(connected(links, "near-round"), "near-roots").withColumnRenamed("node", "at")
    others = [c for c in live.columns if c != "comp"]
    return live.join(roots, F.col("comp") == F.col("at"), "left").select(*others, F.coalesce("root", "comp").alias("comp"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` of components among rows ``band, part, follows, node, n, print, comp, members`` in order: of each band and part the leaders first.

    A row is compared with the leaders of other components, as long as it is not joined with them over what was found here.
    """
    of, leaders, up = None, [], {}

    def root(c: int) -> int:
        while (d := up.get(c, c)) != c:
            up[c] = c = up.get(d, d)
        return c

    for batch in batches:
        found = []
        columns = [batch.column(k).to_pylist() for k in range(7)]
        for i, (band, part, follows, _, n, print_, comp) in enumerate(zip(*columns)):
            if (band, part) != of:
                of, leaders, up = (band, part), [], {}
            own = np.frombuffer(batch.column(7)[i].as_buffer(), np.uint64)
            if not follows:
                leaders.append((n, print_, comp, own))
                continue
            for m, other, c, members in leaders:
                if (
                    min(n, m) * NEAR[1] >= max(n, m) * NEAR[0]
                    and ((print_ ^ other) & _ALL).bit_count() <= WIDE
                    and root(comp) != root(c)
                    and _is_near(own, members)
                ):
                    up[root(comp)] = root(c)
                    found.append((comp, c))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _by_bands(live: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Tables of links ``a, b`` that connect what is near; ``live``: ``band, node, n, print, comp``.

    The rows of a large bucket are dealt into parts, and its leaders go to each; no row stands for a pair.
    """
    out: list[DataFrame] = []
    leaders = LEADERS
    while True:
        sizes = written(live.groupBy("band", "comp").agg(F.count("*").alias("size")), "near-sizes")
        most = F.max(F.struct("size", "comp"))
        open_ = sizes.groupBy("band").agg(F.sum("size").alias("size"), most.alias("most"), F.count("*").alias("n_comps")).filter("n_comps > 1")
        open_ = open_.select(F.col("band").alias("in_band"), "size", F.col("most.comp").alias("largest"), (F.col("size") - F.col("most.size")).alias("outside"))
        open_ = written(open_, "near-open")
        if open_.isEmpty():
            return out
        draw = F.pmod(F.xxhash64(F.lit(len(out)), "node"), F.lit(1 << 30)) * F.col("outside") < F.lit(leaders << 30)
        live = live.join(open_, F.col("band") == F.col("in_band")).withColumn("parts", F.ceil(F.col("size") / PART_ROWS).cast("int"))
        live = live.select("band", "node", "n", "print", "comp", "parts", ((F.col("comp") != F.col("largest")) & draw).alias("leads"))
        live = written(live, "near-live")
        columns = ("band", "part", "follows", "node", "n", "print", "comp")
        rows = live.select("*", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("follows")).select(*columns)
        lead = live.filter("leads").select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("follows")).select(*columns)
        rows = written(rows.union(lead), "near-met").join(sets.withColumnRenamed("node", "s_node").hint("merge"), F.col("node") == F.col("s_node"))
        rows = rows.select(*columns, "members").repartition("band", "part").sortWithinPartitions("band", "part", "follows")
        out.append(written(rows.mapInArrow(_met, "a long, b long"), "near-links"))
        live = written(_joined(live.filter("not leads").drop("leads", "parts"), out[-1]), "near-live")
        leaders = min(leaders * MORE, MOST_LEADERS)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of near copies: that of the smallest id (null last), then any one of the equals.

    A group is what can be reached over pairs of similarity 0.8 or more. Null texts and
    texts without words are one group. An empty table gives no rows; all columns come back as they are. Texts
    stay where they are (see :mod:`rows`).
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = R.in_files(docs, "near-docs")
    with scratch(spark, "near"):
        rows = R.with_place(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "place")
        rows = rows.withColumn("row_id", F.monotonically_increasing_id()).select("doc_id", "place", "row_id", "text")
        rows = written(_sketched(rows), "near-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("u"), "doc_id", "place"))
        nodes = rows.groupBy("set_key").agg(first.alias("m"), F.min(F.struct("row_id", "n", "print", "place", "bands")).alias("s"))
        nodes = written(nodes.select(F.col("s.row_id").alias("node"), "m", "s.n", "s.print", "s.place", "s.bands"), "near-nodes")
        pairs = written(_by_prints(nodes.filter("n > 0")), "near-print-pairs")
        placed = written(nodes.select("node", F.explode("bands").alias("band")), "near-bands")
        shared = placed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1").select("band")
        live = written(placed.join(written(shared, "near-shared").hint("merge"), "band", "left_semi"), "near-shared-bands")
        named = pairs.select(F.col("p").alias("c")).union(pairs.select("q")).union(live.select("node")).distinct()
        about = written(nodes.join(named, F.col("node") == F.col("c"), "left_semi").select("place", F.col("node").alias("value"), "n", "print"), "near-candidates")
        texts = docs.select(F.col(text_col).alias("text"))
        sets = written(R.beside(texts, about.select("place", "value"), "node", _sets, _MEMBERS), "near-sets")
        links = [_checked(pairs.select("p", F.col("p").alias("a"), "q", F.col("q").alias("b")), sets)]
        live = live.join(about.select(F.col("value").alias("at"), "n", "print"), F.col("node") == F.col("at")).drop("at")
        live = written(_joined(live.withColumn("comp", F.col("node")), links[0]), "near-live")
        links += _by_bands(live, sets)
        found = links[0]
        for more in links[1:]:
            found = found.union(more)
        roots = written(connected(found, "near-all"), "near-names").withColumnRenamed("node", "at")
        least = nodes.join(roots.hint("merge"), F.col("node") == F.col("at"), "left").groupBy(F.coalesce("root", "node")).agg(F.min("m").alias("m"))
        stay = written(least.select("m.place", F.lit(1).cast("long").alias("value")), "near-stay")
        return R.beside(docs, stay, R.unused(docs.columns, "stays")[0]).select(*docs.columns)
