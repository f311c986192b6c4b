"""Every registered query against its SQL, on the given tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from spindrift.plans import index_queries, search_queries, text_queries  # noqa: F401
from spindrift.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float) and v == int(v):
        return int(v)
    return v if isinstance(v, (bool, int, str, float)) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
