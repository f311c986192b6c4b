"""Quality of retrieval and of answers on golden cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindrift.functions.text import haystack


def any_token(tokens: Column, hay: Column, alternatives: bool = False) -> Column:
    """Whether any token (with ``alternatives``: any of its parts between bars) is in the text; none asked: true."""
    has = lambda t: hay.contains(F.lower(F.trim(t)) if alternatives else F.lower(t))
    test = (lambda t: F.exists(F.split(t, r"\|"), has)) if alternatives else has
    return F.when(F.size(tokens) > 0, F.exists(tokens, test)).otherwise(True)


def all_groups(tokens: Column, hay: Column) -> Column:
    """Whether each group has a part (between bars) in the text."""
    return F.forall(tokens, lambda g: F.exists(F.split(g, r"\|"), lambda t: hay.contains(F.lower(F.trim(t)))))


def first_hits(cases: DataFrame, results: DataFrame, alternatives: bool = False) -> DataFrame:
    """``query_id, hit_rank``: rank of the first result with an expected token, 0 if none has one."""
    hay = haystack("section_number", "section_title", "breadcrumb", "source_file", "text")
    r = results.select("query_id", "rank", hay.alias("hay"))
    rows = cases.select("query_id", "expect").join(r, "query_id", "left")
    hit = F.col("hay").isNotNull() & (F.size("expect") > 0) & any_token(F.col("expect"), F.col("hay"), alternatives)
    return rows.groupBy("query_id").agg(F.coalesce(F.min(F.when(hit, F.col("rank"))), F.lit(0)).alias("hit_rank"))


def summary(hits: DataFrame) -> DataFrame:
    """One row: cases, hits, hit rate and mean reciprocal rank."""
    hit = F.col("hit_rank") > 0
    return hits.agg(
        F.count("*").alias("cases"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.when(hit, 1.0 / F.col("hit_rank")).otherwise(0.0)), 6).alias("mrr"),
    )


def answer_summary(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Rates of answered cases, and of right authorities and conclusions among the cases that ask for them.

    ``answers``: ``query_id, answer, designations, refused, n_citations``.
    """
    rows = cases.join(answers, "query_id")
    hay = F.lower(F.concat_ws(" ", F.coalesce("answer", F.lit("")), F.array_join("designations", " ")))
    cite, concl = F.size("expect_cite") > 0, F.size("expect_answer") > 0
    return rows.withColumn("hay", hay).agg(
        F.count("*").alias("cases"),
        F.round(F.avg((~F.col("refused") & (F.col("n_citations") > 0)).cast("int")), 6).alias("answered_rate"),
        F.round(F.avg(F.when(cite, any_token(F.col("expect_cite"), F.col("hay")).cast("int"))), 6).alias("cite_rate"),
        F.round(F.avg(F.when(concl, all_groups(F.col("expect_answer"), F.col("hay")).cast("int"))), 6).alias("conclusion_rate"),
    )
