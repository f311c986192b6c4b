"""Queries on retrieval: BM25, vectors, fusion, filters, pools, collapse and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from spindrift.functions import answers as A, facets, text as X
from spindrift.operators import evaluate, inverted, search, substrings, vectors
from spindrift.plans import tables
from spindrift.plans.registry import query
from spindrift.session import table, written

_TERMS = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')"
_POSTINGS = f"""t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY doc_id), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  s AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM l) / cast((SELECT count(*) FROM documents) AS double) AS avg_len)"""
_BM25 = f"""{_POSTINGS}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
  scored AS (SELECT query_id, p.doc_id AS chunk_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
    FROM q JOIN p USING (term) JOIN df USING (term) JOIN l USING (doc_id), s GROUP BY ALL),
  bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 80)"""


def _ranked(spark, d):
    docs = tables.docs(spark, d)
    return docs, written(search.bm25(tables.asked(spark, d), search.postings(docs)), "bm25")


@query("a15_term_statistics", f"WITH {_POSTINGS} SELECT term, df, cast(sum(tf) AS bigint) AS total FROM p JOIN df USING (term) GROUP BY ALL")
def term_statistics(spark, d):
    return search.term_counts(search.postings(tables.docs(spark, d))).withColumn("total", F.col("total").cast("long"))


@query("t02_bm25", f"WITH {_BM25} SELECT query_id, chunk_id, score, cast(rank AS int) AS rank FROM bm25")
def bm25(spark, d):
    return _ranked(spark, d)[1].select("query_id", "chunk_id", "score", "rank")


_KNN = """v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings), knn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_distance(a.e, b.e), 6) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS rank FROM v a, v b WHERE a.vec_id % 100 = 0 QUALIFY rank <= 80)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("t01_knn", f"WITH {_KNN} SELECT query_id, chunk_id, distance, cast(rank AS int) AS rank FROM knn")
def knn(spark, d):
    v = _vectors(spark, d)
    q = v.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")  # a search: the stated set of queries
    return search.knn(q, v).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "a01_fusion",
    f"""WITH {_BM25}, v AS (SELECT vec_id, cast(embedding AS double[]) AS e FROM embeddings),
      knn AS (SELECT item_id AS query_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY item_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS rank
        FROM benchmark JOIN v a ON item_id = a.vec_id, v b QUALIFY rank <= 80),
      u AS (SELECT query_id, chunk_id, rank, 0 AS l FROM knn UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm25)
      SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, cast(min(l * 1000000 + rank) AS int) AS first_pos FROM u GROUP BY ALL""",
)
def fusion(spark, d):
    v = _vectors(spark, d)
    q = tables.asked(spark, d).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id")
    fused = search.fuse([search.knn(q, v), _ranked(spark, d)[1]])
    return fused.select("query_id", "chunk_id", F.round("rrf", 8).alias("rrf"), F.col("first_pos").cast("int").alias("first_pos"))


@query(
    "w02_stratified_pool",
    f"""WITH {_BM25}, r AS (SELECT query_id, chunk_id, rank, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY rank) AS r, min(rank) OVER (PARTITION BY query_id, lang) AS b
        FROM bm25 JOIN documents ON chunk_id = doc_id)
      SELECT query_id, chunk_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY r, b) AS int) AS pool_pos FROM r QUALIFY pool_pos <= 72""",
)
def pool(spark, d):
    docs, hits = _ranked(spark, d)
    rows = hits.join(docs.select("chunk_id", "lang"), "chunk_id")
    return search.stratified(rows, F.col("lang"), F.col("rank")).select("query_id", "chunk_id", "pool_pos")


@query(
    "a11_dominated",
    f"""WITH {_BM25}, g AS (SELECT query_id, lang, count(*) AS c FROM bm25 JOIN documents ON chunk_id = doc_id WHERE rank <= 8 GROUP BY ALL)
      SELECT query_id, max(c) / cast(sum(c) AS double) >= 0.6 OR count(*) <= 1 AS dominated FROM g GROUP BY query_id""",
)
def dominated(spark, d):
    docs, hits = _ranked(spark, d)
    return search.dominated(hits.join(docs.select("chunk_id", "lang"), "chunk_id"), F.col("lang"), 8)


@query(
    "a03_collapse",
    f"""WITH {_BM25} SELECT query_id, source AS section_id, max(score) AS score, cast(min(rank) AS int) AS pool_pos, arg_min(chunk_id, rank) AS chunk_id
      FROM bm25 JOIN documents ON chunk_id = doc_id GROUP BY ALL""",
)
def collapse(spark, d):
    docs, hits = _ranked(spark, d)
    rows = hits.join(docs.select("chunk_id", "source"), "chunk_id").select(
        "query_id", "chunk_id", "score", F.col("rank").alias("pool_pos"), F.lit("docs").alias("corpus"), F.lit("all").alias("path"), F.col("source").alias("section_id")
    )
    return search.collapsed(rows).select("query_id", "section_id", "score", "pool_pos", "chunk_id")


@query(
    "p01_row_filters",
    f"""WITH {tables.DOCS} SELECT doc_id FROM docs WHERE doc_id % 10 <> 0 AND split_part(path, '/', -1) LIKE '%1%.html' AND NOT starts_with(path, 'model/2019') AND path NOT LIKE '%/inspections/guide-%'""",
)
def row_filters(spark, d):
    f = search.Filters(types=("leaf",), file_glob="*1*.html", exclude_globs=("model/2019", "*/inspections/guide-*"))
    return tables.docs(spark, d).filter(search.passes(f)).select("doc_id")


_JURIS = "split_part(path, '/', 1)"
_FACETS = f"""{tables.DOCS}, f AS (SELECT doc_id, path, {_JURIS} AS jurisdiction,
  CASE lang WHEN 'en' THEN split_part(path, '/', 3) WHEN 'de' THEN 'ncbc' WHEN 'fr' THEN 'udo' ELSE split_part(path, '/', 2) END AS family,
  CASE lang WHEN 'en' THEN split_part(path, '/', 2) ELSE regexp_extract(CASE WHEN lang = 'de' THEN path ELSE edition END, '(?:19|20)\\d{{2}}') END AS year,
  CASE lang WHEN 'en' THEN concat(upper(split_part(path, '/', 3)), ' (model)') WHEN 'de' THEN 'NC Building Code' WHEN 'fr' THEN 'Durham UDO'
    ELSE concat('Edition  of ', source) END AS doc_label, CASE lang WHEN 'en' THEN 'model' WHEN 'de' THEN 'state' WHEN 'fr' THEN 'local-durham' ELSE 'federal' END AS tier FROM docs)"""


@query("f16_facets", f"WITH {_FACETS} SELECT doc_id, jurisdiction, family, year, concat(jurisdiction, ':', family) AS doc_key, doc_label, tier FROM f")
def facet(spark, d):
    return tables.docs(spark, d).select("doc_id", facets.facet("path", "edition").alias("f"), facets.tier("jurisdiction").alias("tier")).select("doc_id", "f.*", "tier")


@query(
    "p04_locations",
    f"""WITH {_FACETS}, loc AS (SELECT * FROM (VALUES ('durham-nc', ['model', 'federal', 'state', 'local-durham', 'other']), ('north-carolina', ['model', 'federal', 'state', 'other']),
        ('model', ['model']), ('graham-nc', ['model', 'federal', 'state', 'local-graham', 'other'])) x(location, tiers))
      SELECT location, tier, count(*) AS n FROM f, loc WHERE list_contains(tiers, tier) GROUP BY ALL""",
)
def locations(spark, d):
    where = facets.location_table(spark).filter(F.col("location").isin("durham-nc", "north-carolina", "model", "graham-nc"))
    rows = tables.docs(spark, d).groupBy(facets.tier("jurisdiction").alias("tier")).agg(F.count("*").alias("n"))
    return rows.join(where, "tier").select("location", "tier", "n")


_VERSIONS = f"""{_FACETS}, ver AS (SELECT concat(jurisdiction, ':', family) AS doc_key, arg_min(doc_label, path) AS doc_label, array_to_string(list_sort(list_distinct(list(year)), 'DESC'), ',') AS years,
  max(year) AS default_year, count(DISTINCT year) > 1 AS versioned FROM f GROUP BY 1)"""


@query("a07_corpus_versions", f"WITH {_VERSIONS} SELECT * FROM ver")
def versions(spark, d):
    v = facets.corpus_versions(tables.docs(spark, d))
    return v.select("doc_key", "doc_label", F.array_join("years", ",").alias("years"), "default_year", "versioned")


@query(
    "a08_versions_in_force",
    f"""WITH {_VERSIONS}, w AS (SELECT doc_key, CASE WHEN contains(years, '2019') THEN '2019' ELSE default_year END AS want FROM ver WHERE versioned)
      SELECT doc_id FROM f LEFT JOIN w ON w.doc_key = concat(jurisdiction, ':', family) WHERE tier IN ('model', 'federal', 'state', 'other') AND (want IS NULL OR year = want)""",
)
def versions_in_force(spark, d):
    docs = tables.docs(spark, d)
    v = facets.corpus_versions(docs)
    want = facets.resolve_versions(v, v.select("doc_key", F.lit("2019").alias("wanted")))
    return search.in_force(docs, search.Filters(location="north-carolina", versions=want)).select("doc_id")


@query(
    "p06_short_code_filter",
    """WITH x AS (SELECT source AS query_id, doc_id, regexp_matches(concat(text, ' ', upper(lang), cast(doc_id % 7 AS string)), concat('\\b', 'EN', '3', '\\b')) AS hit FROM documents)
      SELECT query_id, doc_id FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS found FROM x) WHERE hit OR NOT found""",
)
def short_code_filter(spark, d):
    rows = table(spark, d, "documents").select(
        F.col("source").alias("query_id"), "doc_id", F.concat("text", F.lit(" "), F.upper("lang"), (F.col("doc_id") % 7).cast("string")).alias("text"), F.lit("what of EN3").alias("q")
    )
    return search.with_codes(rows).select("query_id", "doc_id")


@query(
    "p09_status",
    f"""WITH {_BM25}, asked AS (SELECT item_id AS query_id, lang FROM benchmark, (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
        tops AS (SELECT query_id, lang, max(1.0 / (60 + rank)) AS top FROM bm25 JOIN documents ON chunk_id = doc_id GROUP BY ALL)
      SELECT query_id, lang, CASE WHEN top IS NULL THEN 'no_results' WHEN top < 0.01 THEN 'low_confidence' ELSE 'ok' END AS status FROM asked LEFT JOIN tops USING (query_id, lang)""",
)
def status(spark, d):
    """How sure the search of each item is within each language."""
    docs, hits = _ranked(spark, d)
    per = hits.join(docs.select("chunk_id", "lang"), "chunk_id").select(F.struct("query_id", "lang").alias("query_id"), "chunk_id", "rank")
    top = search.fuse([per]).groupBy("query_id").agg(F.max("rrf").alias("top"))
    languages = docs.filter("lang is not null").select("lang").distinct()
    asked = tables.asked(spark, d).crossJoin(F.broadcast(languages)).select(F.struct("query_id", "lang").alias("query_id"))  # a handful of languages
    return asked.join(top, "query_id", "left").select("query_id.*", A.status(F.col("top")).alias("status"))


_SEARCH = rf"""{_BM25}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= 250),
  {tables.DOCS}, k AS (SELECT doc_id, text, source, split_part(path, '/', 1) AS j FROM docs),
  codes AS (SELECT item_id AS query_id, unnest([y FOR y IN [regexp_replace(x, '^[.\-''"]+|[.\-''"]+$', '', 'g') FOR x IN regexp_split_to_array(text, '[\s,;:()\[\]{{}}/]+')]
    IF regexp_matches(y, '^[A-Z0-9]{{2,8}}$') AND regexp_matches(y, '[A-Z]') AND regexp_matches(y, '[0-9]')]) AS code FROM benchmark),
  x AS (SELECT r.*, j, source, round(1.0 / (60 + rank), 12) AS rrf, EXISTS (SELECT 1 FROM codes c WHERE c.query_id = r.query_id AND regexp_matches(k.text, concat('', code, ''))) AS hit
    FROM r JOIN k ON chunk_id = doc_id WHERE j <> 'durham'),
  y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, rank, chunk_id) AS pos FROM (SELECT *, bool_or(hit) OVER (PARTITION BY query_id) AS found FROM x) WHERE hit OR NOT found),
  z AS (SELECT *, row_number() OVER (PARTITION BY query_id, j ORDER BY pos, chunk_id) AS turn, min(pos) OVER (PARTITION BY query_id, j) AS begins FROM y),
  pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, begins, j) AS pool_pos FROM z QUALIFY pool_pos <= 72),
  c AS (SELECT query_id, j, source, max(rrf) AS score, min(pool_pos) AS pool_pos, arg_min(chunk_id, pool_pos) AS chunk_id FROM pool GROUP BY ALL),
  h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pool_pos) AS rank, CASE WHEN max(score) OVER (PARTITION BY query_id) < 0.01 THEN 'low_confidence' ELSE 'ok' END AS status FROM c QUALIFY rank <= 8),
  sec AS (SELECT DISTINCT j, source FROM k),
  e AS (SELECT query_id, rank, j, h.source AS by_, concat('src', cast((cast(regexp_extract(h.source, '\d+') AS int) + 1) % 20 AS string)) AS dst, status, max(rank) OVER (PARTITION BY query_id) AS n FROM h),
  f AS (SELECT e.* FROM e JOIN sec ON sec.j = e.j AND sec.source = dst WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = e.query_id AND h.j = e.j AND h.source = dst)
    QUALIFY row_number() OVER (PARTITION BY query_id, e.j, dst ORDER BY rank, e.j, by_) = 1),
  g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, j, by_, dst) AS ref_rank FROM f QUALIFY ref_rank <= 3)"""


@query(
    "c10_search",
    f"""WITH {_SEARCH} SELECT query_id, cast(rank AS int) AS rank, source AS section_id, j AS path, chunk_id, round(score, 8) AS score, status, cast(NULL AS string) AS referenced_by FROM h
      UNION ALL SELECT query_id, cast(n + ref_rank AS int), dst, j, -1, -1.0, status, by_ FROM g""",
)
def full_search(spark, d):
    """The whole retrieval of all benchmark items: BM25, filters, balanced pool, collapse to sources, ancestors, one hop of references."""
    docs = tables.docs(spark, d).withColumn("section_id", F.col("source"))
    docs = docs.withColumn("path", F.col("jurisdiction"))
    sections = written(docs.select("corpus", "path", "section_id", F.lit(None).cast("string").alias("parent_section_id"), "edition").dropDuplicates(["path", "section_id"]), "sections")
    number = F.regexp_extract("section_id", r"\d+", 0).cast("int")
    to = F.concat(F.lit("src"), ((number + 1) % 20).cast("string"))
    refs = sections.select("corpus", "path", F.col("section_id").alias("src_section_id"), F.lit("next").alias("dst_raw"), F.col("path").alias("dst_path"), to.alias("dst_section_id"))
    found = search.search(tables.asked(spark, d), docs, sections, refs, filters=search.Filters(location="north-carolina"), balance=True)
    return found.withColumns({"score": F.round("score", 8), "chunk_id": F.coalesce("chunk_id", F.lit(-1).cast("long"))}).drop("corpus")


@query(
    "a02_probe_fusion",
    f"""WITH {_BM25}, r AS (SELECT query_id % 10 AS question_id, query_id AS probe_no, source AS section_id, max(score) AS score, min(rank) AS m FROM bm25 JOIN documents ON chunk_id = doc_id GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY question_id, probe_no ORDER BY m) AS rank FROM r)
      SELECT question_id, section_id, round(sum(1.0 / (60 + rank)), 8) AS rrf, max(score) AS score FROM k GROUP BY ALL""",
)
def probe_fusion(spark, d):
    docs, hits = _ranked(spark, d)
    per = hits.join(docs.select("chunk_id", "source"), "chunk_id").groupBy("query_id", "source").agg(F.max("score").alias("score"), F.min("rank").alias("m"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("m"))
    rows = per.select((F.col("query_id") % 10).alias("question_id"), F.col("query_id").alias("probe_no"), F.col("source").alias("section_id"), "score", rank.alias("rank"))
    return search.fuse_probes(rows, 1_000).select("question_id", "section_id", F.round("rrf", 8).alias("rrf"), "score")


@query(
    "u02_probes",
    r"""WITH e AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, p ORDER BY turn) AS rn FROM e WHERE p <> ''),
        k AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no FROM f WHERE rn = 1)
      SELECT conv_id AS question_id, cast(no AS int) AS probe_no, p AS probe FROM k WHERE no < 4""",
)
def probes(spark, d):
    """The turns of a conversation as its probes."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    plans = turns.select(F.col("conv_id").alias("question_id"), F.get("t", F.lit(0))["text"].alias("cleaned_query"), F.transform("t", lambda x: x["text"]).alias("probes"), F.array().cast("array<string>").alias("extras"))
    return search.probes(plans, most=4)


_EVAL = f"""{_BM25}, c AS (SELECT item_id AS query_id, lower(text) AS e FROM benchmark),
  h AS (SELECT c.query_id, coalesce(min(CASE WHEN contains(lower(d.text), e) THEN rank END), 0) AS hit_rank FROM c LEFT JOIN (SELECT * FROM bm25 WHERE rank <= 15) b USING (query_id) LEFT JOIN documents d ON b.chunk_id = d.doc_id GROUP BY 1)"""


@query("a13_first_hits", f"WITH {_EVAL} SELECT query_id, cast(hit_rank AS int) AS hit_rank FROM h")
def first_hits(spark, d):
    return _hits(spark, d).select("query_id", F.col("hit_rank").cast("int").alias("hit_rank"))


@query(
    "a12_eval_summary",
    f"""WITH {_EVAL} SELECT count(*) AS cases, count(*) FILTER (hit_rank > 0) AS hits, round(avg(CASE WHEN hit_rank > 0 THEN 1 ELSE 0 END), 6) AS hit_rate,
      round(avg(CASE WHEN hit_rank > 0 THEN 1.0 / hit_rank ELSE 0 END), 6) AS mrr FROM h""",
)
def eval_summary(spark, d):
    return evaluate.summary(_hits(spark, d))


def _hits(spark, d):
    docs, hits = _ranked(spark, d)
    none = F.lit(None).cast("string")
    found = hits.filter("rank <= 15").join(docs.select("chunk_id", "text"), "chunk_id").select(
        "query_id", "rank", none.alias("section_number"), none.alias("section_title"), none.alias("breadcrumb"), none.alias("source_file"), "text"
    )
    cases = tables.asked(spark, d).select("query_id", F.array("q").alias("expect"))
    return evaluate.first_hits(cases, found)


@query(
    "p12_answer_rates",
    """WITH a AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS hay, count(*) FILTER (role = 'assistant') AS c FROM conversations GROUP BY conv_id)
      SELECT count(*) AS cases, round(avg(CASE WHEN conv_id % 7 <> 0 AND c > 0 THEN 1 ELSE 0 END), 6) AS answered_rate, round(avg(CASE WHEN contains(hay, 'the ') THEN 1 ELSE 0 END), 6) AS cite_rate,
        round(avg(CASE WHEN (contains(hay, 'of') OR contains(hay, 'de')) AND (contains(hay, 'and') OR contains(hay, 'der')) THEN 1 ELSE 0 END), 6) AS conclusion_rate FROM a""",
)
def answer_rates(spark, d):
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer"),
        F.count_if(F.col("role") == "assistant").alias("n_citations"),
    )
    answers = turns.withColumn("refused", F.col("query_id") % 7 == 0).withColumn("designations", F.array().cast("array<string>"))
    cases = turns.select("query_id", F.array(F.lit("The ")).alias("expect_cite"), F.array(F.lit("of | de"), F.lit("and|der")).alias("expect_answer"))
    return evaluate.answer_summary(cases, answers)


def _index(spark, d, **options):
    return inverted.build(tables.docs(spark, d).select("chunk_id", "text"), **options)


@query("t02_block_max", f"WITH {_BM25} SELECT query_id, chunk_id, score, cast(rank AS int) AS rank FROM bm25 WHERE rank <= 10")
def block_max(spark, d):
    """The ten best chunks of each item, reading only the blocks that can hold one."""
    return inverted.search(tables.asked(spark, d), _index(spark, d, width=8), 10, phrases=False).hits


_PLACES = f"w AS (SELECT doc_id, {_TERMS} AS w FROM documents), places AS (SELECT doc_id, w, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS p FROM w)"


@query(
    "f13_phrases",
    f"""WITH {_PLACES}, i AS (SELECT {_TERMS} AS w FROM benchmark), pairs AS (SELECT DISTINCT w[k] AS a, w[k + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i)),
      hits AS (SELECT a, b, doc_id, count(*) AS n FROM places JOIN pairs ON term = a AND w[p + 1] = b GROUP BY ALL)
      SELECT concat(a, ' ', b) AS phrase, count(*) AS n_chunks, cast(sum(n) AS bigint) AS n_places, min(doc_id) AS first_chunk FROM hits GROUP BY a, b""",
)
def phrases(spark, d):
    """Each pair of neighbours in a benchmark item as a phrase, searched in all documents."""
    words = tables.asked(spark, d).select(X.terms("q").alias("w"))
    pair = lambda i: F.slice("w", i, F.lit(2))
    asked = words.filter(F.size("w") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), pair)).alias("phrase")).distinct()
    hits = inverted.phrase_postings(asked, _index(spark, d))
    out = hits.groupBy("phrase").agg(F.count("*").alias("n_chunks"), F.sum(F.size("at")).alias("n_places"), F.min("chunk_id").alias("first_chunk"))
    return out.withColumn("phrase", F.array_join("phrase", " "))


_PHRASES = rf"""{_PLACES}, l AS (SELECT doc_id, len(w) AS len FROM w), s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM l),
  x AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(regexp_replace(text, '["()*:^]', ' ', 'g'), '\s+')) AS text FROM benchmark),
  q AS (SELECT query_id, f, count(*) AS times FROM (SELECT query_id, {_TERMS} AS f FROM x) WHERE len(f) > 0 GROUP BY ALL),
  t AS (SELECT f, doc_id, count(*) AS tf FROM places JOIN (SELECT DISTINCT f FROM q) ON term = f[1] AND w[p : p + len(f) - 1] = f GROUP BY ALL),
  df AS (SELECT f, count(*) AS df FROM t GROUP BY f),
  scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
    FROM q JOIN t USING (f) JOIN df USING (f) JOIN l USING (doc_id), s GROUP BY ALL)"""


@query("t02_phrases", f"WITH {_PHRASES} SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS int) AS rank FROM scored QUALIFY rank <= 80")
def phrase_search(spark, d):
    """BM25 in which a word of several terms counts where its terms follow one another."""
    return inverted.search(tables.asked(spark, d), _index(spark, d)).hits


@query(
    "p01_filtered_top",
    f"""WITH {_BM25}, allowed AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark, documents
        WHERE item_id % 5 = 4 OR lang IN ('en', CASE item_id % 5 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'xx' END) AND (item_id % 5 <> 3 OR source IN ('src1', 'src2', 'src3')))
      SELECT query_id, chunk_id, score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS int) AS rank
      FROM scored JOIN allowed USING (query_id, chunk_id) QUALIFY rank <= 10""",
)
def filtered_top(spark, d):
    """The ten best chunks of each item among those that pass its filter: two languages, one, one with three sources, or none."""
    index = _index(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.explode(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("facet", "value"))
    filters = spark.createDataFrame(
        [(k, "lang", v) for k, vs in ((0, "en fr"), (1, "en de"), (2, "en xx"), (3, "en xx")) for v in vs.split()] + [(3, "source", f"src{n}") for n in (1, 2, 3)],
        "filter_id int, facet string, value string",
    )
    asked = tables.asked(spark, d).withColumn("filter_id", F.nullif((F.col("query_id") % 5).cast("int"), F.lit(4)))
    allowed = inverted.allowed(filters, inverted.facet_bitmaps(docs, index))
    return inverted.search(asked, index, 10, allowed, phrases=False).hits


@query("t01_lists")
def knn_lists(spark, d):
    """The ten nearest vectors by inverted lists, for the queries of t01; tests measure the recall."""
    v = _vectors(spark, d)
    q = v.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")  # a search: the stated set of queries
    return vectors.knn_lists(q, vectors.build_lists(v), 10).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "p05_filtered_knn",
    """WITH v AS (SELECT vec_id, cast(embedding AS double[]) AS e, label, vec_id % 3 AS third FROM embeddings)
      SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_distance(a.e, b.e), 6) AS distance,
        cast(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS int) AS rank
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.label IN (a.label, (a.label + 1) % 10) AND b.third = 1 QUALIFY rank <= 10""",
)
def filtered_knn(spark, d):
    """The ten nearest vectors of two labels and one third of the ids, for the queries of t01: filtered before the top-k."""
    rows = table(spark, d, "embeddings")
    index = inverted.build(rows.select(F.col("vec_id").alias("chunk_id"), F.lit("").alias("text")))
    text = lambda c: c.cast("string")
    facet = F.explode(F.create_map(F.lit("label"), text(F.col("label")), F.lit("third"), text(F.col("vec_id") % 3))).alias("facet", "value")
    bitmaps = inverted.facet_bitmaps(rows.select(F.col("vec_id").alias("chunk_id"), facet), index)
    filters = spark.createDataFrame([(n, f, v) for n in range(10) for f, v in (("label", str(n)), ("label", str((n + 1) % 10)), ("third", "1"))], "filter_id int, facet string, value string")
    q = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("filter_id"))  # a search: the stated set of queries
    hits = vectors.knn_filtered(q, _vectors(spark, d), inverted.allowed(filters, bitmaps), index, 10)
    return hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "p14_substrings",
    "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''",
)
def contained(spark, d):
    """Documents that contain a benchmark item, in whatever case, by the substring index."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = substrings.search(tables.asked(spark, d), substrings.build(rows), rows)
    return found.select(F.col("query_id").alias("item_id"), F.col("chunk_id").alias("doc_id"))
