"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a budget of words: shares by weight, none above a multiple of its
source's size, the excess dealt out again. A budget is first filled with complete
epochs; what is left is filled with a weighted sample without replacement, drawn as
the documents of smallest exponential key ``-ln(u) / quality`` up to the budget.
The order within a source is never sorted as a whole: keys fall into ranges, range
sums are accumulated, and only the one range in which the budget ends is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spindrift.llm import rows as R
from spindrift.session import scratch, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in one range of keys, what a task sorts at a time; and ranges in one of the wider ranges that are accumulated first.
RANGE_ROWS = 1000
#: Quality weights: bad or toxic, unlabelled, good.
QUALITIES = (0.5, 1.0, 2.0)


def n_words(text: Column) -> Column:
    """Words of the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the values alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[float], total: float, limit: float) -> DataFrame:
    """``source, source_no, source_docs, source_size, target`` for a table of ``source, size``.

    The sources, by code point and null last, take the weights in turn. They share
    ``total`` times all sizes by weight; a target stops at ``limit`` times its source's size.
    The level at which the shares settle is found in one pass over the sources in the
    order of limit to weight: those before the level stop at their limit. One row per
    source goes through one task here, never one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    named = per.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    named = named.withColumn("w", turn).withColumn("cap", F.col("source_size") * float(limit))
    everything = W.partitionBy(F.lit(1))
    steepness = everything.orderBy((F.col("cap") / F.col("w")).asc(), "source_no")
    before = steepness.rowsBetween(W.unboundedPreceding, -1)
    every = steepness.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    named = (
        named.withColumn("left", F.sum("source_size").over(everything) * float(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.when(F.col("cap") / F.col("w") > F.col("left") / F.col("w_left"), F.col("left") / F.col("w_left")))
        .withColumn("level", F.first("level", ignorenulls=True).over(every))  # that of the first source below its limit
    )
    share = F.least(F.col("cap"), F.col("w") * F.coalesce(F.col("level"), F.lit(float("inf"))))
    return named.select("source", "source_no", "source_docs", "source_size", share.alias("target"))


def mix(
    docs: DataFrame,
    labels: DataFrame | None = None,
    weights: Sequence[float] = (3, 1, 2),
    total: float = 1.5,
    limit: float = 2.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, times, row_id``.

    ``taken`` is the number of words the mix takes from the document, a whole multiple
    of its size: the complete epochs, and once more if it is sampled. A sampled
    document never carries its source past the target. Quality weights come from
    ``labels`` (``doc_id, quality, toxic``): 2 for good, 0.5 for bad or toxic, else 1.
    Null text has no words; null is a source of its own; rows with a null id share a key
    and are told apart by their text. Empty tables give no rows. Other columns of
    ``docs`` are not read. ``times`` says how often the document is taken. ``row_id`` tells
    repeated ids apart: the values of ``row_col``, or else numbers of this result.
    """
    slim = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )
    slim = written(slim, "op1-sizes")
    sources = written(source_targets(slim, weights, total, limit), "op1-sources")

    quality = F.lit(1.0)
    keyed = slim
    if labels is not None:
        marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        marks = written(marks.select(F.col("doc_id").alias("l_id"), "quality", "toxic"), "op1-labels")
        keyed = slim.join(marks, F.col("doc_id") == F.col("l_id"), "left")
        quality = (
            F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 0.5).when(F.col("quality") == 1, 2.0).otherwise(1.0)
        )
    s = sources.select(F.col("source").alias("s_source"), "source_no", "source_docs", "source_size", "target")
    keyed = keyed.join(s, F.col("source").eqNullSafe(F.col("s_source")))
    keyed = keyed.withColumn("q", quality).withColumn("key", -F.log(uniform(seed, F.col("doc_id"), F.col("tie"))) / F.col("q"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    keyed = keyed.withColumn("epochs", epochs.cast("long"))
    keyed = written(keyed.select("row_id", "doc_id", "source_no", "source_docs", "source_size", "target", "size", "tie", "q", "key", "epochs"), "op1-keys")

    # Ranges that hold about as many documents each: by the distribution of the keys of the source's mixture of weights.
    per = keyed.groupBy("source_no").agg(*[F.avg((F.col("q") == w).cast("double")).alias(f"w{i}") for i, w in enumerate(QUALITIES)])
    per = written(per.withColumnRenamed("source_no", "w_no"), "op1-weights")
    below = sum((F.col(f"w{i}") * (1 - F.exp(-w * F.col("key"))) for i, w in enumerate(QUALITIES)), F.lit(0.0))
    part = F.floor(below * F.ceil(F.col("source_docs") / RANGE_ROWS))
    keyed = keyed.join(per, F.col("source_no") == F.col("w_no")).withColumn("part", part).drop("w_no", "source_docs", "q", *[f"w{i}" for i in range(len(QUALITIES))])

    # Range sums, accumulated in two steps, ranges of ranges first: in one range of each source the budget ends.
    rest = F.first(F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")
    sums = written(keyed.groupBy("source_no", "part").agg(F.sum("size").alias("n"), rest), "op1-sums").withColumn("wide", F.floor(F.col("part") / RANGE_ROWS))
    wide = _ending(sums.groupBy("source_no", "wide").agg(F.sum("n").alias("n"), F.first("rest").alias("rest")), "wide")
    wide = written(wide.select(F.col("source_no").alias("e_no"), F.col("wide").alias("e_wide"), F.col("rest").alias("e_rest")), "op1-wide")
    inner = sums.join(wide, (F.col("source_no") == F.col("e_no")) & (F.col("wide") == F.col("e_wide"))).withColumn("rest", F.col("e_rest"))
    ends = _ending(inner.select("source_no", "part", "n", "rest"), "part")
    ends = written(ends.select(F.col("source_no").alias("e_no"), F.col("part").alias("e_part"), "rest"), "op1-ends")

    rows = keyed.join(ends, F.col("source_no") == F.col("e_no"), "left")
    whole = F.col("e_part").isNull() | (F.col("part") < F.col("e_part"))
    in_last = written(_fill(rows.filter("part = e_part")), "op1-last")
    rows = rows.select("row_id", "doc_id", "size", "source_size", "target", "epochs", whole.alias("whole"))
    picked = in_last.select(F.col("row_id").alias("p_row"), F.lit(True).alias("picked"))
    rows = rows.join(picked, F.col("row_id") == F.col("p_row"), "left")
    times = F.col("epochs") + (F.col("whole") | F.coalesce(F.col("picked"), F.lit(False))).cast("long") * (
        F.col("epochs") < F.lit(float(limit))
    ).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), "row_id")


def mixed(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns unchanged.

    Null and empty texts have no words: they come as often as their source is taken whole. Texts stay where they are (see
    :mod:`rows`); an empty table gives no rows.
    """
    columns = docs.columns
    docs = R.in_files(docs, "op1-docs")
    read = dict.fromkeys(options.get(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    place, times = R.unused(columns, "place", "times")
    with scratch(docs.sparkSession, "op1"):
        slim = R.with_place(docs.select(*read), place)
        taken = mix(slim, labels, row_col=place, **options).filter("times > 0")
        taken = written(taken.select(F.col("row_id").alias("place"), F.col("times").alias("value")), "op1-times")
        rows = R.beside(docs, taken, times)
    again = R.unused([*columns, times], "again")[0]
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns)


def _ending(sums: DataFrame, part: str) -> DataFrame:
    """``source_no, part, rest``: of sums ``n`` by part, the first part of each source with which ``rest`` is exceeded, and what is left of it there."""
    upto = F.sum("n").over(W.partitionBy("source_no").orderBy(part))
    over = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
    end = over.groupBy("source_no").agg(F.min_by(F.struct(part, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")), part).alias("e"))
    return end.select("source_no", "e.*")


def _fill(last: DataFrame, passes: int = 4) -> DataFrame:
    """Of the last range of each source: the rows that fill its rest, in the order of the keys.

    First the longest run of rows that fits; then, of the rows that are no longer than the
    gap it leaves, the longest run that fits the gap, and so on.
    """
    order = W.partitionBy("source_no").orderBy("key", "size", "tie", "row_id")
    own = W.partitionBy("source_no")
    run = last.withColumn("gap", F.col("rest")).withColumn("in", F.lit(False))
    for _ in range(passes):
        open_ = ~F.col("in") & (F.col("size") <= F.col("gap"))
        run = run.withColumn("open", open_).withColumn("cum", F.sum(F.when(F.col("open"), F.col("size")).otherwise(0)).over(order))
        run = run.withColumn("new", F.col("open") & (F.col("cum") <= F.col("gap")))
        run = run.withColumn("gap", F.col("gap") - F.coalesce(F.max(F.when(F.col("new"), F.col("cum"))).over(own), F.lit(0)))
        run = run.withColumn("in", F.col("in") | F.col("new"))
    return run.filter("in").select("row_id")
