"""The given tables seen as a corpus: documents with paths, and customers as a section tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindrift.session import table

#: Path of a document (an expression of both dialects): model codes, state codes, local and federal papers by language.
PATH = """CASE lang
  WHEN 'en' THEN concat('model/', cast(2018 + doc_id % 4 AS string), '/', CASE doc_id % 3 WHEN 0 THEN 'ibc' WHEN 1 THEN 'irc' ELSE 'ipc' END, '/', cast(doc_id AS string), '.html')
  WHEN 'de' THEN concat('north-carolina/NCBC', cast(2018 + doc_id % 4 AS string), '/', cast(doc_id AS string), '.html')
  WHEN 'fr' THEN concat('durham/inspections/', CASE WHEN doc_id % 2 = 0 THEN 'udo-' ELSE 'guide-' END, cast(doc_id AS string), '.html')
  ELSE concat('federal/ada-', cast(2010 + doc_id % 3 AS string), '/', cast(doc_id AS string), '.html') END"""
EDITION = "concat('Edition ', cast(2018 + doc_id % 4 AS string), ' of ', source)"
#: Documents as chunks, and the start of a SQL query over them.
DOCS = f"docs AS (SELECT doc_id, text, lang, source, {PATH} AS path, {EDITION} AS edition FROM documents)"
TREE = """tree AS (
  SELECT concat('r', cast(r_regionkey AS string)) AS section_id, cast(NULL AS string) AS parent_section_id,
    cast(r_regionkey + 1 AS string) AS section_number, r_name AS section_title, r_regionkey AS a, -1 AS b, cast(-1 AS bigint) AS c FROM region
  UNION ALL SELECT concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)),
    concat(cast(n_regionkey + 1 AS string), '.', cast(n_nationkey + 1 AS string)), n_name, n_regionkey, n_nationkey, cast(-1 AS bigint) FROM nation
  UNION ALL SELECT concat('c', cast(c_custkey AS string)), concat('n', cast(c_nationkey AS string)),
    concat(cast(n_regionkey + 1 AS string), '.', cast(n_nationkey + 1 AS string), '.', cast(c_custkey AS string)), c_name, n_regionkey, n_nationkey, c_custkey
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, chunk_id, text, lang, source, path, edition, jurisdiction, corpus, section_id, source_file``."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.expr(PATH).alias("path"), F.expr(EDITION).alias("edition"))
    return rows.withColumns(
        {
            "chunk_id": F.col("doc_id"),
            "corpus": F.lit("docs"),
            "section_id": F.concat(F.lit("d"), F.col("doc_id").cast("string")),
            "source_file": F.substring_index("path", "/", -1),
            "jurisdiction": F.substring_index("path", "/", 1),
            "node_type": F.when(F.col("doc_id") % 10 == 0, "table").otherwise("leaf"),
        }
    )


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as sections of three levels; ``a, b, c`` order them."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    num = lambda *xs: F.concat_ws(".", *[x.cast("string") for x in xs])
    a, b = F.col("n_regionkey") + 1, F.col("n_nationkey") + 1
    top = r.select(
        key("r", "r_regionkey").alias("section_id"), F.lit(None).cast("string").alias("parent_section_id"), num(F.col("r_regionkey") + 1).alias("section_number"),
        F.col("r_name").alias("section_title"), F.col("r_regionkey").alias("a"), F.lit(-1).alias("b"), F.lit(-1).cast("long").alias("c"),
    )
    mid = n.select(key("n", "n_nationkey"), key("r", "n_regionkey"), num(a, b), "n_name", "n_regionkey", "n_nationkey", F.lit(-1).cast("long"))
    low = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        key("c", "c_custkey"), key("n", "c_nationkey"), num(a, b, F.col("c_custkey")), "c_name", "n_regionkey", "n_nationkey", "c_custkey"
    )
    return top.union(mid).union(low)


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's items as queries: ``query_id, q``."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
