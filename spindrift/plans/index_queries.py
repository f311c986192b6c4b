"""Queries on the section tree, the citation graph, the index life cycle and the logs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from spindrift.functions import text as X
from spindrift.operators import graph, index_store
from spindrift.plans import tables
from spindrift.plans.registry import query
from spindrift.session import table, written
from spindrift.sources import files
from spindrift.streaming import histories, logs

_T = tables.TREE


@query(
    "f08_breadcrumbs",
    f"""WITH {_T} SELECT t.section_id, concat_ws(' > ', p2.section_number || ' ' || p2.section_title, p1.section_number || ' ' || p1.section_title, t.section_number || ' ' || t.section_title) AS breadcrumb
      FROM tree t LEFT JOIN tree p1 ON t.parent_section_id = p1.section_id LEFT JOIN tree p2 ON p1.parent_section_id = p2.section_id""",
)
def crumbs(spark, d):
    return graph.breadcrumbs(graph.trails(tables.tree(spark, d), depth=4))


def _ordered(spark, d):
    """The tree with reading order: nodes numbered within their region; nations with an odd key have a letter before their number."""
    rows = tables.tree(spark, d).withColumn("corpus", F.lit("tpc")).withColumn("path", F.concat(F.lit("region-"), F.col("a").cast("string")))
    letter = F.when((F.col("b") >= 0) & (F.col("c") < 0) & (F.col("b") % 2 == 1), "R").otherwise("")
    rows = rows.withColumn("section_number", F.concat(letter, "section_number"))
    # reading order without a window over a region: regions, nations and customers by their keys
    ord_ = (F.col("b") + 1).cast("long") * (1 << 40) + F.col("c") + 1
    return rows.withColumn("ord", ord_).withColumn("own_text", F.col("section_title"))


@query(
    "f09_full_text",
    f"""WITH {_T}, o AS (SELECT *, CASE WHEN section_id LIKE 'r%' THEN section_id WHEN section_id LIKE 'n%' THEN parent_section_id ELSE concat('r', cast(a AS string)) END AS r FROM tree)
      SELECT section_id, (SELECT sha256(string_agg(section_title, concat(chr(10), chr(10)) ORDER BY b, c)) FROM o x
        WHERE x.a = t.a AND (t.b < 0 OR (x.b = t.b AND (t.c < 0 OR x.c = t.c)))) AS h FROM o t""",
)
def full_text(spark, d):
    rows = written(_ordered(spark, d), "tree")
    return graph.rolled_up(rows, graph.trails(rows, depth=4)).select("section_id", F.sha2("full_text", 256).alias("h"))


def _referring(spark, d):
    """Customers refer to their nation's section by its bare number, to their own, to one that is not there, and to a statute.

    Every third names a statute whose number begins that of the others.
    """
    rows = _ordered(spark, d)
    number = F.concat((F.col("a") + 1).cast("string"), F.lit("."), (F.col("b") + 1).cast("string"))
    statute = F.when(F.col("c") % 3 == 0, "160D-11").otherwise("160D-1110")
    text = F.concat(F.lit("See Section "), number, F.lit(" and § "), F.col("section_number"), F.lit(", R"), number, F.lit(" or N.C.G.S. "), statute, F.lit("(b); Table 99.9."))
    rows = rows.withColumn("own_text", F.coalesce(F.when(F.col("c") >= 0, text), F.lit("")))
    return rows.withColumn("full_text", F.when(F.col("b") < 0, F.concat("section_title", F.lit(" under 2160d-11104.5 and more"))).otherwise(F.col("own_text")))


@query(
    "c06_references",
    f"""WITH {_T} SELECT section_id AS src_section_id, unnest([concat(cast(a + 1 AS string), '.', cast(b + 1 AS string)), section_number, '99.9', CASE WHEN c % 3 = 0 THEN '160D-11' ELSE '160D-1110' END]) AS dst_raw,
      unnest(['internal_section', 'internal_section', 'internal_section', 'ncgs']) AS dst_kind FROM tree WHERE c >= 0""",
)
def references(spark, d):
    return graph.extract_refs(_referring(spark, d)).select("src_section_id", "dst_raw", "dst_kind")


_TEXTS = f"""{_T}, f AS (SELECT section_id, a, CASE WHEN b < 0 THEN concat(section_title, ' under 2160d-11104.5 and more') WHEN c < 0 THEN '' ELSE concat('See Section ', cast(a + 1 AS string), '.',
    cast(b + 1 AS string), ' and § ', section_number, ', R', cast(a + 1 AS string), '.', cast(b + 1 AS string), ' or N.C.G.S. ', CASE WHEN c % 3 = 0 THEN '160D-11' ELSE '160D-1110' END, '(b); Table 99.9.') END AS t FROM tree),
  raws AS (SELECT unnest(['160D-11', '160D-1110']) AS raw),
  longest AS (SELECT raw, section_id, row_number() OVER (PARTITION BY raw ORDER BY length(t) DESC, concat('region-', cast(a AS string)), section_id) AS n FROM raws JOIN f ON t ILIKE concat('%', raw, '%') QUALIFY n <= 2)"""


_RESOLVED = f"""WITH {_TEXTS}, x AS (SELECT section_id AS src_section_id, unnest([concat(cast(a + 1 AS string), '.', cast(b + 1 AS string)), section_number, '99.9']) AS dst_raw,
          unnest([parent_section_id, NULL, NULL]) AS dst_section_id FROM tree WHERE c >= 0
        UNION ALL SELECT src, raw, (SELECT section_id FROM longest l WHERE l.raw = k.raw AND l.section_id <> src ORDER BY n LIMIT 1)
          FROM (SELECT section_id AS src, CASE WHEN c % 3 = 0 THEN '160D-11' ELSE '160D-1110' END AS raw FROM tree WHERE c >= 0) k)
      SELECT * FROM x"""


@query("c07_resolved", _RESOLVED)
def resolved(spark, d):
    rows = written(graph.spread(_referring(spark, d)), "sections")
    refs = written(graph.extract_refs(rows), "refs")
    return graph.resolve_refs(refs, rows).select("src_section_id", "dst_raw", "dst_section_id")


@query("k05_delta_refs", _RESOLVED)
def delta_resolved(spark, d):
    """All references after one region's file came, one was written anew and one went, from what was resolved before."""
    after = written(graph.spread(_referring(spark, d)), "sections")
    first, second, gone = "region-0", "region-1", "region-9"
    longer = F.concat("full_text", F.lit(" and much more of it, N.C.G.S. 160D-1110 and 160D-11."))
    before = after.filter(F.col("path") != first)
    before = before.withColumn("full_text", F.when(F.col("path") == second, longer).otherwise(F.col("full_text")))
    before = before.withColumn("section_number", F.when(F.col("path") == second, F.concat(F.lit("Q"), "section_number")).otherwise(F.col("section_number")))
    extra = after.filter(F.col("path") == first).withColumn("path", F.lit(gone)).withColumn("section_id", F.concat(F.lit("x-"), "section_id"))
    before = written(before.unionByName(extra.withColumn("section_number", F.when(F.col("c") >= 0, F.lit("99.9")).otherwise(F.col("section_number")))), "before")
    old_refs, old_keys = written(graph.extract_refs(before), "old-refs"), written(graph.listed_keys(before), "old-keys")
    touched = written(spark.createDataFrame([("tpc", p) for p in (first, second, gone)], "corpus string, path string"), "touched")
    # as a build does: only sections of touched files are read, all else is as it was stored
    new = after.join(touched, ["corpus", "path"], "left_semi")
    refs = index_store.replaced(old_refs, written(graph.extract_refs(new), "new-refs"), touched)
    keys = index_store.replaced(old_keys, written(graph.listed_keys(new), "new-keys"), touched)
    now = graph.propagate(written(graph.resolve_by(old_refs, old_keys), "resolved"), refs, old_keys, keys, touched)
    return now.select("src_section_id", "dst_raw", "dst_section_id")


def _segments(spark, d):
    """Market segments as queries; their customers and those customers' nations as results."""
    c = table(spark, d, "customer")
    low = c.select(F.col("c_mktsegment").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("section_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_section_id"))
    every = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("section_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_section_id"))
    rows = low.union(c.select(F.col("c_mktsegment").alias("query_id")).distinct().join(F.broadcast(every)))  # 25 nations
    return rows.withColumn("corpus", F.lit("tpc")).withColumn("path", F.lit("all"))


@query(
    "j07_drop_ancestors",
    """WITH r AS (SELECT c_mktsegment AS query_id, concat('c', cast(c_custkey AS string)) AS section_id, concat('n', cast(c_nationkey AS string)) AS parent FROM customer
        UNION ALL SELECT DISTINCT c_mktsegment, concat('n', cast(n_nationkey AS string)), concat('r', cast(n_regionkey AS string)) FROM customer, nation)
      SELECT query_id, section_id FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.query_id = r.query_id AND x.parent = r.section_id)""",
)
def ancestors(spark, d):
    return graph.drop_ancestors(_segments(spark, d)).select("query_id", "section_id")


@query(
    "j03_expansion",
    """WITH s AS (SELECT s_nationkey AS query_id, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier),
        h AS (SELECT DISTINCT query_id, rank, s_suppkey, l_partkey FROM s JOIN lineitem ON l_suppkey = s_suppkey),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, l_partkey ORDER BY rank, concat('s', cast(s_suppkey AS string))) AS n FROM h QUALIFY n = 1)
      SELECT query_id, concat('p', cast(l_partkey AS string)) AS section_id, concat('s', cast(s_suppkey AS string)) AS referenced_by,
        cast(row_number() OVER (PARTITION BY query_id ORDER BY rank, concat('s', cast(s_suppkey AS string)), lpad(cast(l_partkey AS string), 9, '0')) AS int) AS ref_rank FROM o QUALIFY ref_rank <= 3""",
)
def expansion(spark, d):
    """Nations as queries, all their suppliers as results, and the parts that those sell as what they refer to."""
    s = table(spark, d, "supplier")
    rank = F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey"))
    placed = lambda rows, path: rows.withColumn("corpus", F.lit("tpc")).withColumn(path, F.lit("all"))
    results = placed(s.select(F.col("s_nationkey").alias("query_id"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("section_id"), rank.alias("rank")), "path")
    part = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    refs = table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_section_id"), F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("dst_raw"), part("l_partkey").alias("dst_section_id")
    ).distinct()
    sections = placed(table(spark, d, "part").select(part("p_partkey").alias("section_id")), "path")
    return graph.expand_once(results, placed(placed(refs, "path"), "dst_path"), sections).select("query_id", "section_id", "referenced_by", "ref_rank")


def _disk(spark, d):
    return tables.docs(spark, d).select("corpus", "path", X.content_hash("text").alias("sha256"), "doc_id")


def _indexed(spark, d):
    """An older state: every fifth file is not there yet, every seventh has other content, and some are gone since."""
    rows = _disk(spark, d).filter("doc_id % 5 <> 0")
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("sha256"))
    gone = rows.filter("doc_id % 11 = 1").select("corpus", F.concat("path", F.lit(".bak")).alias("path"), "sha256")
    return rows.select("corpus", "path", sha.alias("sha256")).union(gone)


_STATE = f"""{tables.DOCS}, i AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS s FROM docs WHERE doc_id % 5 <> 0
  UNION ALL SELECT concat(path, '.bak'), sha256(text) FROM docs WHERE doc_id % 5 <> 0 AND doc_id % 11 = 1),
  ch AS (SELECT coalesce(k.path, i.path) AS path, CASE WHEN k.path IS NULL THEN 'gone' WHEN i.path IS NULL THEN 'new' WHEN i.s = sha256(k.text) THEN 'same' ELSE 'changed' END AS action FROM docs k FULL JOIN i ON k.path = i.path)"""


@query("j08_changes", f"WITH {_STATE} SELECT path, action FROM ch")
def changes(spark, d):
    return index_store.changes(_disk(spark, d), _indexed(spark, d)).select("path", "action")


@query("k01_replaced", f"WITH {_STATE} SELECT path, s AS sha256 FROM i WHERE path NOT IN (SELECT path FROM ch WHERE action <> 'same') UNION ALL SELECT docs.path, sha256(text) FROM docs JOIN ch USING (path) WHERE action IN ('new', 'changed')")
def replaced(spark, d):
    disk, old = _disk(spark, d).drop("doc_id"), _indexed(spark, d)
    touched = written(index_store.changes(disk, old).filter("action <> 'same'"), "touched")
    new = disk.join(touched.select("corpus", "path"), ["corpus", "path"], "left_semi")
    return index_store.replaced(old, new, touched).select("path", "sha256")


@query("k04_purged", f"WITH {tables.DOCS} SELECT doc_id FROM docs WHERE path NOT LIKE 'durham/%'")
def purged(spark, d):
    docs = tables.docs(spark, d)
    return index_store.purged(docs, docs.filter("jurisdiction = 'durham'").select("corpus", "path")).select("doc_id")


@query(
    "a05_stats",
    "SELECT lang AS corpus, 'documents' AS table_name, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT lang, 'labels', count(*) FROM labels JOIN documents USING (doc_id) GROUP BY 1",
)
def stats(spark, d):
    docs = table(spark, d, "documents").withColumn("corpus", F.col("lang"))
    return index_store.stats({"documents": docs, "labels": table(spark, d, "labels").join(docs.select("doc_id", "corpus"), "doc_id")})


@query("a04_sources", f"WITH {tables.DOCS} SELECT source AS source_file, min(path) AS path, count(*) AS n FROM docs GROUP BY 1")
def sources(spark, d):
    return tables.docs(spark, d).groupBy(F.col("source").alias("source_file")).agg(F.min("path").alias("path"), F.count("*").alias("n"))


@query("a06_editions", f"WITH {tables.DOCS} SELECT DISTINCT split_part(path, '/', 1) AS jurisdiction, edition FROM docs")
def editions(spark, d):
    return tables.docs(spark, d).select("jurisdiction", "edition").distinct()


@query(
    "a09_skip_reasons",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 6 = 5 THEN 'excluded_by_ext' WHEN strlen(text) * 10000 > 104857600 THEN 'file_too_large' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1""",
)
def skip_reasons(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".txt", ".html", ".pdf", ".docx", ".md", ".exe"))), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, d, "documents").select(ext.alias("ext"), (F.octet_length("text").cast("long") * 10000).alias("size"))
    return files.skipped(rows).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "a10_build_plan",
    "SELECT count(*) AS files, count(*) AS chunks, sum(least(length(text), 30000)) AS chars, sum(least(length(text), 30000)) // 4 AS tokens, round(sum(least(length(text), 30000)) // 4 / 1e6 * 0.13, 6) AS usd, sum(least(length(text), 30000)) // 4 / 1e6 * 0.13 > 1 AS ask FROM documents",
)
def build_plan(spark, d):
    docs = tables.docs(spark, d)
    plan = index_store.build_plan(docs, docs.withColumn("embed_input", F.col("text")))
    return plan.select("files", "chunks", "chars", "tokens", F.round("usd", 6).alias("usd"), "ask")


@query(
    "a14_coverage",
    "SELECT coalesce(r_name, 'TOTAL') AS title, count(DISTINCT n_nationkey) AS chapters, count(*) AS sections FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)",
)
def coverage(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    out = rows.rollup("r_name").agg(F.countDistinct("n_nationkey").alias("chapters"), F.count("*").alias("sections"))
    return out.select(F.coalesce("r_name", F.lit("TOTAL")).alias("title"), "chapters", "sections")


@query(
    "s24_corpora",
    f"WITH {tables.DOCS}, j AS (SELECT DISTINCT split_part(path, '/', 1) AS corpus FROM docs) SELECT corpus, corpus = coalesce((SELECT max(corpus) FROM j WHERE corpus = 'durham'), (SELECT min(corpus) FROM j)) AS is_primary FROM j",
)
def corpora(spark, d):
    j = tables.docs(spark, d).select(F.col("jurisdiction").alias("corpus")).distinct()
    best = j.agg(F.coalesce(F.max(F.when(F.col("corpus") == "durham", F.col("corpus"))), F.min("corpus")).alias("best"))
    return j.crossJoin(F.broadcast(best)).select("corpus", (F.col("corpus") == F.col("best")).alias("is_primary"))  # one row


@query("w09_history", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def history(spark, d):
    w = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return table(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 6").select("conv_id", "turn", "text")


@query("w09_stream", "SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def history_stream(spark, d):
    """The conversations as a stream: the last six turns of each, from the state."""
    stream = spark.readStream.schema(table(spark, d, "conversations").schema).parquet(f"{d}/conversations.parque[t]")  # a pattern: a stream takes no path of a single file
    return histories.latest(histories.replayed(stream))


@query(
    "k06_feedback_days",
    "SELECT date_trunc('day', ts) AS start, event_type AS rating, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def feedback_days(spark, d):
    rows = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("start"), F.col("event_type").alias("rating"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "e03_stream_windows",
    """SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type AS rating, count(*) AS n FROM events
      WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '7 hours' <= (SELECT max(ts) FROM events) GROUP BY ALL""",
)
def stream_windows(spark, d):
    """The events as a stream: windows of six hours that the watermark, an hour behind, has passed, in append mode."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return logs.drained(logs.windowed(stream, "ts", "event_type", "6 hours", "1 hour"))
