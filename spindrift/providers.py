"""Models behind the engine, as replaceable providers: embeddings, rerank scores, paraphrases, chat.

None of them is needed to build or search an index. The defaults are deterministic: hashed
term vectors, no reranker, paraphrases from a table of synonyms, and canned replies.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindrift.functions import text as X

#: Requests: rows and characters at most, attempts, first and longest pause in seconds.
ROWS, CHARS, ATTEMPTS, PAUSE, LONGEST = 256, 500_000, 6, 1.0, 60.0


class Overloaded(Exception):
    """A request is too large for the service: halve it."""


class Chat(Protocol):
    def __call__(self, prompts: Sequence[str]) -> list[str]: ...


def hashed_vector(dim: int = 64) -> Callable[[Column], Column]:
    """Embedding of a text by its terms: signed hashed counts, of length one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                v[h % dim] += 1 if h >> 16 & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).astype(np.float32))
        return pd.Series(out)

    return lambda c: embed(X.embed_guard(c))


def batched(call: Callable[[list[str]], list], texts: list[str], sleep=time.sleep) -> list:
    """Results of ``call`` for all texts, in requests of bounded size; halves what is too large, waits and retries what fails."""
    out: list = []
    at = 0
    size, failures = ROWS, 0
    while at < len(texts):
        n = chars = 0
        while at + n < len(texts) and n < size and (not n or chars + len(texts[at + n]) <= CHARS):
            chars += len(texts[at + n])
            n += 1
        try:
            out += call(texts[at : at + n])
            at, failures = at + n, 0
        except Overloaded:
            if n == 1:
                raise
            size = n // 2
        except OSError:
            failures += 1
            if failures == ATTEMPTS:
                raise
            sleep(min(LONGEST, PAUSE * 2 ** (failures - 1)))
    return out


def remote_vector(client: Callable[[], Callable[[list[str]], list]]) -> Callable[[Column], Column]:
    """Embedding by a service: ``client`` is made once per partition and called with bounded requests."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = client()
        for texts in batches:
            yield pd.Series(batched(call, texts.fillna("").tolist()))

    return lambda c: embed(X.embed_guard(c))


def paraphrases(queries: DataFrame, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, variant, q``: each query and up to ``most`` copies with a word replaced (``word, instead``)."""
    words = queries.select("query_id", "q", F.explode(F.array_distinct(X.terms("q"))).alias("word")).join(synonyms, "word")
    swapped = words.select("query_id", F.regexp_replace(X.fold("q"), F.concat(F.lit(r"\b"), "word", F.lit(r"\b")), F.col("instead")).alias("q"))
    ordered = swapped.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set("q")), 1, most).alias("v"))
    rows = queries.select("query_id", F.array("q").alias("v")).union(ordered)
    first = F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct(F.size("v").alias("n"), "v"))).getField("v")))
    base = rows.join(queries.select("query_id", "q"), "query_id").groupBy("query_id", "q").agg(first.alias("all"))
    variants = F.array_distinct(F.concat(F.array("q"), "all"))
    return base.select("query_id", F.posexplode(F.slice(variants, 1, most + 1)).alias("variant", "text")).withColumnRenamed("text", "q")


def replies(prompts: DataFrame, chat: Chat, rows: int = 64) -> DataFrame:
    """``prompts`` (with ``prompt``) and ``reply``: the provider is called in the tasks, with ``rows`` prompts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = [r for i in range(0, len(pdf), rows) for r in chat(pdf["prompt"].iloc[i : i + rows].tolist())]
            yield pdf.assign(reply=said)

    return prompts.mapInPandas(run, T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())]))
