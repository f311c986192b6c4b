"""A substring index: which texts contain which strings, in whatever case, without comparing each string with each text.

Texts are cut into grams of three characters (and of two and one, for strings that are no longer). A block is what one task
read in a row, about BLOCK characters of texts: one row for a gram and a block, with the ids of the block's texts that hold it. Blocks
are written where they are made, so building moves no text and no posting, and a frequent gram has a row in each block.

A search reads how many texts hold the grams of its strings, keeps the RARE rarest of each string, intersects their lists block by
block, and compares what is left with the texts. Strings of three characters or fewer are one gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from spindrift.session import bound_batches, new_shared_path, written

#: Characters of a block, about (a text is never split); grams of a string whose lists are intersected; strings that a row of the comparison holds, about.
BLOCK, RARE, TOGETHER = 1 << 20, 6, 1000
#: Bytes of strings up to which all of them are sent to the tasks that compare, and candidates are numbers; above, candidates carry their strings.
LEXICON = 8 << 20
POSTINGS = "block long, gram long, n int, ids array<long>"


def grams(text: str) -> np.ndarray:
    """The distinct grams of a text as numbers: 21 bits a character, and no character is zero."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    pairs = (c[:-1] << 21) | c[1:]
    return np.unique(np.concatenate([c, pairs, (pairs[:-1] << 21) | c[2:]]))


def needed(text: str) -> np.ndarray:
    """The grams that a text must hold to contain the given one: the longest that there are."""
    longest = min(len(text), 3)
    found = grams(text)
    return found[found >= 1 << 21 * (longest - 1)] if longest else found


def build(texts: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the postings (``block, gram, n, ids``) of texts (``chunk_id`` long, ``text``) to a folder and return a reader of them.

    Null texts hold nothing; rows of one id count together.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    folder = folder or new_shared_path(spark, "substrings")
    slim = texts.filter("text is not null and chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("text"))
    slim.mapInArrow(_blocks, POSTINGS).write.parquet(folder)
    return spark.read.schema(POSTINGS).parquet(folder)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first, made, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0
    for batch in batches:
        for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            ids.append(chunk)
            held.append(grams(text))
            size += len(text)
            if size >= BLOCK:
                yield _block(first + made, ids, held)
                made, ids, held, size = made + 1, [], [], 0
    if ids:
        yield _block(first + made, ids, held)


def _block(no: int, ids: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    all_grams = np.concatenate(held)
    owner = np.repeat(np.array(ids, np.int64), [len(h) for h in held])
    order = np.argsort(all_grams, kind="stable")
    all_grams, owner = all_grams[order], owner[order]
    start = np.flatnonzero(np.r_[True, all_grams[1:] != all_grams[:-1]]) if len(all_grams) else np.zeros(0, np.int64)
    ends = np.r_[start, len(all_grams)].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(owner))
    block = pa.array(np.full(len(start), no, np.int64))
    return pa.record_batch([block, pa.array(all_grams[start]), pa.array(np.diff(ends).astype(np.int32)), lists], ["block", "gram", "n", "ids"])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [needed(q) for q in batch.column(1).to_pylist()]
        no = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        yield pa.record_batch([pa.array(no), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["no", "gram"])


def candidates(needles: DataFrame, postings: DataFrame, rare: int = RARE) -> DataFrame:
    """``no, chunk_id`` of texts that hold the rarest grams of each needle (``no`` long, ``q``): all that contain it, and some others."""
    asked = written(needles.select("no", "q").mapInArrow(_needed, "no long, gram long"), "asked-grams")
    heads = postings.select("gram", "n").join(asked.select("gram").distinct(), "gram", "left_semi")
    df = heads.groupBy("gram").agg(F.sum("n").alias("df"))
    # a gram that no text holds comes first, and its needle meets fewer lists than it wants
    by_rarity = W.partitionBy("no").orderBy(F.coalesce("df", F.lit(0)), "gram")
    chosen = asked.join(df, "gram", "left").withColumn("r", F.row_number().over(by_rarity)).filter(F.col("r") <= rare)
    chosen = written(chosen.withColumn("wanted", F.count("*").over(W.partitionBy("no"))).select("no", "gram", "wanted"), "rare-grams")
    lists = postings.select("block", "gram", "ids").join(chosen, "gram").groupBy("no", "block", "wanted").agg(F.collect_list("ids").alias("lists"))
    whole = lists.filter(F.size("lists") == F.col("wanted"))
    both = F.aggregate(F.slice("lists", 2, rare), F.get("lists", F.lit(0)), F.array_intersect)
    return whole.select("no", F.explode(F.array_distinct(both)).alias("chunk_id"))


def search(queries: DataFrame, postings: DataFrame, texts: DataFrame, rare: int = RARE) -> DataFrame:
    """``query_id, chunk_id``: the texts (``chunk_id, text``) that contain a query (``query_id, q``), in whatever case, each pair once.

    The empty string is in every text and is left out, and so are null queries and texts. Queries of one id are one by one, and equal
    strings are searched once. A text meets its candidates together, so that a long one that many ask for is read once for some TOGETHER of them.
    """
    asked = queries.select("query_id", F.lower("q").alias("q")).filter("q <> ''")
    asked = written(asked, "asked")
    needles = written(asked.select("q").distinct().withColumn("no", F.monotonically_increasing_id()), "needles")
    n, size = needles.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("q")), F.lit(0))).first()
    by_number = size <= LEXICON
    hits = candidates(needles, postings, rare)
    hits = hits if by_number else hits.join(needles, "no")
    group = F.pmod(F.xxhash64("no"), F.lit(max(1, -(-n // TOGETHER))))
    hits = hits.groupBy("chunk_id", group.alias("g")).agg(F.collect_list("no" if by_number else "q").alias("wanted")).drop("g")
    # written as large as it is: where Spark's size check lets it broadcast this table, the texts stay where they are
    folder = new_shared_path(queries.sparkSession, "candidates")
    hits.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).parquet(folder)
    hits = queries.sparkSession.read.schema(hits.schema).parquet(folder)
    lower = texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("text").alias("t"))
    met = hits.join(lower, "chunk_id").select("chunk_id", "t", F.explode("wanted").alias("no" if by_number else "q"))
    met = met.join(F.broadcast(needles), "no") if by_number else met
    found = met.filter(F.contains(F.col("t"), F.col("q"))).select("chunk_id", "q")
    return asked.join(found.distinct(), "q").select("query_id", "chunk_id").distinct()
