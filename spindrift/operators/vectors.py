"""Nearest vectors within groups: inverted lists for approximate search, and exact search below a filter.

An inverted list holds the vectors that are nearest to one centroid. Centroids are fitted on a bounded sample; every vector is in one list.
A query reads the lists of its nearest centroids only. The exact way is :func:`spindrift.operators.search.knn`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from spindrift.operators import inverted
from spindrift.operators.search import QUERY_BLOCK, VECTOR_BLOCK, knn, matrix, nearest_rows, ranked
from spindrift.session import new_shared_path, open_store, written

#: Vectors that centroids are fitted on at most (the smallest by hash of their ids, so that reruns agree), and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 12
#: Lists; tasks that the vectors of a list are dealt over; vectors that are asked to find how many lists a query must read, for which recall.
LISTS, SPREAD, ASKED, RECALL = 32, 8, 256, 0.95


def fit_centroids(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """``lists`` centroids at most (one a row), by Lloyd's rounds on ``sample`` vectors (``chunk_id, embedding``); none of an empty table.

    The first centroids are the sample's vectors farthest from those before them, so that equal vectors give one.
    """
    drawn = vectors.filter("embedding is not null").select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow()
    if not len(drawn):
        return np.zeros((0, 0))
    x = matrix(drawn.column("embedding").combine_chunks())
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    while len(chosen) < min(lists, len(x)) and (not chosen or far.max() > 0):
        chosen.append(int(far.argmax()))
        d = ((x - x[chosen[-1]]) ** 2).sum(axis=1)
        far = d if len(chosen) == 1 else np.minimum(far, d)
    c = x[chosen]
    for _ in range(rounds):
        own = _nearest_centroids(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c


def _nearest_centroids(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` nearest centroids of each vector, the nearest first."""
    d = (c**2).sum(axis=1) - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)


def _with_lists(rows: DataFrame, c: np.ndarray, n: int, key: str) -> DataFrame:
    """``key, embedding, lists``: the numbers of the ``n`` nearest centroids."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = _nearest_centroids(matrix(b.column(1)), c, n)
                ends = pa.array(np.arange(len(b) + 1) * near.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(near.reshape(-1)))], names=[key, "embedding", "lists"])

    slim = rows.filter("embedding is not null").select(key, F.col("embedding").cast("array<float>"))
    return slim.mapInArrow(run, f"{key} {kind}, embedding array<float>, lists array<int>")


@dataclass(frozen=True)
class Lists:
    """Inverted lists in a folder: ``vectors`` (chunk_id, embedding, list), and the centroids."""

    vectors: DataFrame
    centroids: np.ndarray


def build_lists(vectors: DataFrame, lists: int = LISTS, folder: str | None = None, **fit) -> Lists:
    """Put every vector (``chunk_id, embedding``, one length) into the list of its nearest centroid. Null vectors are left out."""
    spark = vectors.sparkSession
    folder = folder or new_shared_path(spark, "lists")
    c = fit_centroids(vectors, lists, **fit)
    if len(c):
        rows = _with_lists(vectors, c, 1, "chunk_id").select("chunk_id", "embedding", F.get("lists", F.lit(0)).alias("list"))
    else:
        rows = vectors.limit(0).select("chunk_id", "embedding", F.lit(0).alias("list"))
    # a list may hold many of the vectors: it is dealt over tasks
    rows.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))).write.partitionBy("list").parquet(f"{folder}/vectors")
    numbers = [(i, v) for i, v in enumerate(c.tolist())]
    spark.createDataFrame(numbers, "list int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> Lists:
    """The lists that were built in a folder."""
    rows = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # LISTS rows
    vectors = spark.read.schema("chunk_id long, embedding array<float>, list int").parquet(f"{folder}/vectors")
    return Lists(vectors, np.array([r["centroid"] for r in rows]) if rows else np.zeros((0, 0)))


def probes_for(index: Lists, k: int, recall: float = RECALL, asked: int = ASKED) -> int:
    """The fewest lists to read so that ``recall`` of the ``k`` nearest are found, measured on ``asked`` of the vectors (by hash of their ids).

    Their neighbours are searched exactly once; where the list of each stands in its query's order of centroids says how many are found with how many lists.
    """
    if not len(index.centroids):
        return 1
    drawn = index.vectors.orderBy(F.xxhash64("chunk_id", F.lit("probes")), "chunk_id").limit(asked).select(F.col("chunk_id").alias("query_id"), "embedding")
    drawn = written(drawn, "asked")
    true = knn(drawn, index.vectors, k).select("query_id", "chunk_id").join(index.vectors.select("chunk_id", "list"), "chunk_id")
    order = _with_lists(drawn, index.centroids, len(index.centroids), "query_id").select("query_id", "lists")
    place = true.join(order, "query_id").groupBy(F.array_position("lists", F.col("list")).alias("p")).count().collect()  # LISTS rows
    found = np.zeros(len(index.centroids))
    for r in place:
        found[r["p"] - 1] = r["count"]
    return int(np.searchsorted(np.cumsum(found), recall * found.sum())) + 1


def knn_lists(queries: DataFrame, index: Lists, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: the ``k`` nearest vectors of each query vector in the lists of its ``probes`` nearest centroids.

    Without ``probes`` as many lists are read as :func:`probes_for` finds. With as many probes as lists this is exact.
    """
    asked = queries.select("query_id", "embedding")
    if not len(index.centroids):
        return asked.limit(0).select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    probing = _with_lists(asked, index.centroids, probes or probes_for(index, k), "query_id").select("query_id", "embedding", F.explode("lists").alias("group"))
    return knn_within(probing, index.vectors.withColumnRenamed("list", "group"), k)


def knn_filtered(queries: DataFrame, vectors: DataFrame, allowed: DataFrame, index: inverted.Inverted, k: int) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: for each query (``query_id, filter_id``, embedding) the ``k`` nearest vectors that its filter lets through, exactly.

    ``allowed`` are bitmaps of :func:`inverted.allowed` over the chunk numbers of ``index``. A vector goes to the queries of the filters that it passes.
    """
    placed = vectors.join(index.numbers.select("chunk_id", "no", F.expr(f"no div {index.width}").alias("range")), "chunk_id")
    mask = inverted.masks(allowed, index.width).select(F.col("filter_id").cast("int").alias("group"), "range", "mask")
    rows = placed.join(mask, "range").filter(inverted.passes(F.col("mask"), F.col("no"), index.width)).select("chunk_id", "embedding", "group")
    asked = queries.filter("filter_id is not null").select("query_id", "embedding", F.col("filter_id").cast("int").alias("group"))
    return knn_within(asked, rows, k)


def knn_within(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, chunk_id, distance, rank``: the ``k`` nearest vectors (``chunk_id, embedding, group``) of each query (``query_id, embedding, group``) in its groups.

    Groups are whole numbers. Queries are written by group; a task reads those of the groups that its vectors have, ``block`` at a time, and
    passes on ``k`` rows a query and block of vectors. Groups that no query asks for are not read.
    """
    asked = queries.filter("embedding is not null and group is not null").select("query_id", F.col("embedding").cast("array<float>"), F.col("group").cast("int"))
    folder = new_shared_path(queries.sparkSession, "grouped-queries")
    asked.repartition("group").write.partitionBy("group").parquet(folder)
    kind = asked.schema["query_id"].dataType.simpleString()
    groups = asked.sparkSession.read.schema(asked.schema).parquet(folder).select("group").distinct()
    slim = vectors.filter("embedding is not null").join(groups, "group", "left_semi").select("chunk_id", F.col("embedding").cast("array<float>"), F.col("group").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        held: list[pa.RecordBatch] = []

        def found() -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            names, group = own.column(0).to_numpy(), own.column(2).to_numpy()
            x = matrix(own.column(1).combine_chunks())
            for g in np.unique(group).tolist():
                if store.get_file_info(f"{root}/group={g}").type == fs.FileType.NotFound:
                    continue
                at = np.flatnonzero(group == g)
                for q in pyarrow.dataset.dataset(f"{root}/group={g}", filesystem=store, format="parquet").to_batches(batch_size=block):
                    if len(q):
                        yield nearest_rows(q.column(0), matrix(q.column(1)), names[at], x[at], k)

        for b in batches:
            if len(b):
                held.append(b)
            if sum(map(len, held)) >= VECTOR_BLOCK:
                yield from found()
        if held:
            yield from found()

    return ranked(slim.mapInArrow(run, f"query_id {kind}, chunk_id long, distance double"), F.col("distance").asc(), k)
