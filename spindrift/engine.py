"""The library's entry points: build, status, purge, search, answer, and the loop that asks for more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from spindrift.functions import answers as A, text as X
from spindrift.operators import chunking, graph, index_store, inverted, search
from spindrift.providers import Chat, hashed_vector, paraphrases, replies
from spindrift.session import written
from spindrift.sources import files, html

#: What a model says when the excerpts do not help, and the rounds in which it may ask for more.
REFUSAL, ROUNDS = "I can't answer that from the sources.", 2
#: Sections of one probe, and what a provider is asked for before the search.
PER_PROBE = 8
PLAN = "Plan the search for this question. Reply with one JSON object: cleaned_query, search_queries, rules_to_check."
FILES = "corpus string, path string, sha256 string, size long, status string"


class NeedsConfirmation(Exception):
    """The estimated cost of embedding is above the limit."""


def chunked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and section nodes of files (``corpus, path, ext, text, pages``): by section where pages mark them, by heading or page of paper, else by window."""
    docs = docs.withColumn("source_file", X.basename("path"))
    is_html = F.col("ext").isin(".html", ".htm")
    book = F.when(is_html, F.nullif(X.sanitize_ascii(X.source_label(X.html_meta("text", "book"))), F.lit("")))
    docs = docs.withColumn("label", book)
    pages = written(docs.filter(is_html & F.col("text").isNotNull()).withColumn("s", html.section_tree("text")), "html")
    tree = pages.filter(F.size("s") > 0).select("corpus", "path", "source_file", "label", F.explode("s").alias("s")).select("corpus", "path", "source_file", "label", "s.*")
    key = F.concat("path", F.lit("#"), "section_id")
    parent = F.concat("path", F.lit("#"), "parent_section_id")
    tree = tree.withColumn("section_id", key).withColumn("parent_section_id", parent)
    tree = tree.withColumn("own_text", X.sanitize_ascii("own_text")).withColumn("section_title", F.nullif(X.sanitize_ascii("section_title"), F.lit("")))
    tree = written(tree.withColumn("edition", X.edition("label", "source_file")).withColumn("jurisdiction", X.jurisdiction("path")), "tree")
    trail = written(graph.trails(tree), "trails")
    tree = tree.join(graph.breadcrumbs(trail), "section_id").withColumn("page", F.lit(None).cast("int"))
    nodes = graph.rolled_up(tree, trail)
    flat = pages.filter(F.size("s") == 0).withColumn("text", html.flat_text("text")).drop("s")
    plain = docs.filter(~is_html & F.col("text").isNotNull()).unionByName(flat).withColumn("text", X.sanitize_ascii("text"))
    windows = chunking.chunk_texts(plain).withColumn("node_type", F.lit("leaf")).withColumn("page", F.lit(None).cast("int"))
    paper = docs.filter("pages is not null").withColumn("pages", F.transform("pages", X.sanitize_ascii))
    paged, paged_nodes = chunking.chunk_pages(paper)
    keep = ["corpus", "path", "chunk_id", "section_id", "section_number", "section_title", "breadcrumb", "edition", "jurisdiction", "piece_no", "node_type", "text", "meta", "embed_input", "content_hash", "page"]
    chunks = chunking.chunk_sections(tree).select(*keep).unionByName(windows.select(*keep)).unionByName(paged.withColumn("node_type", F.lit("leaf")).select(*keep))
    node_cols = ["corpus", "path", "section_id", "parent_section_id", "section_number", "section_title", "breadcrumb", "edition", "jurisdiction", "own_text", "full_text"]
    return chunks.withColumn("source_file", X.basename("path")), nodes.select(*node_cols).unionByName(paged_nodes.select(*node_cols))


def build(
    spark: SparkSession, folder: str, corpus: str, root: str, embed: Callable[[Column], Column] | None = None, full: bool = False,
    dry_run: bool = False, confirm: bool = False, prune: bool = True, limit: int | None = None, pdf_pages: Callable[[bytes], list[str]] | None = None,
) -> DataFrame:
    """Bring the index of a corpus up to date with a folder; returns the plan (files, chunks, tokens, cost).

    Files are hashed first; only new and changed ones are parsed, chunked and embedded, each distinct text once (``limit``: the first so many of them, by path); files that are gone
    leave with ``prune``. Nothing is written by a dry run or if the cost is above the limit and
    not confirmed. Files without text are remembered with the reason, so that they are not read again; ``pdf_pages`` reads PDF files.
    Tables of other corpora are not touched. Only references that the changed files hold, or that ask for what these list, are resolved again.
    """
    index_store.check_corpus(corpus)
    store = index_store.IndexStore(spark, root)
    known = store.read("files", corpus) if corpus in store.corpora() else spark.createDataFrame([], FILES)
    disk = written(files.listed(spark, folder, corpus, pdf_pages is not None), "disk")
    readable = disk.filter("reason is null or reason = 'no_reader'")
    change = written(index_store.changes(readable, known, full or store.schema_outdated(corpus)), "changes")
    work = change.filter("action in ('new', 'changed')").select("corpus", "path")
    if limit is not None:
        work = written(work.orderBy("path").limit(limit), "limited")
    todo = written(files.read_files(spark, folder, corpus, pdf_pages, work), "texts")
    chunks, sections = chunked(todo)
    chunks, sections = written(index_store.one_each(chunks, "chunks"), "chunks"), written(index_store.one_each(sections, "sections"), "sections")
    plan = written(index_store.build_plan(todo, chunks), "plan")
    if dry_run:
        return plan
    if plan.first()["ask"] and not confirm:
        raise NeedsConfirmation(f"estimated cost {plan.first()['usd']:.2f} USD")
    touched = change.filter("action = 'gone'").select("corpus", "path").union(work) if prune else work
    _put(store, corpus, todo, chunks, sections, touched, embed)
    return plan


def _put(
    store: index_store.IndexStore, corpus: str, todo: DataFrame, chunks: DataFrame, sections: DataFrame, touched: DataFrame, embed: Callable[[Column], Column] | None
) -> None:
    """Commit parsed files (``todo``) with their chunks and sections in place of all that the index holds of the ``touched`` ones."""
    vectors = chunks.select("content_hash", "embed_input").dropDuplicates(["content_hash"])
    vectors = vectors.select("content_hash", (embed or hashed_vector())(F.col("embed_input")).alias("embedding"))
    chunks = written(chunks.join(vectors, "content_hash"), "embedded")
    index_store.check_chunks(chunks)
    status = chunks.groupBy("corpus", "path").count().select("corpus", "path", F.lit("ok").alias("status"))
    entries = todo.select("corpus", "path", "sha256", "size", "reason").join(status, ["corpus", "path"], "left")
    entries = entries.select("corpus", "path", "sha256", "size", F.coalesce("status", "reason", F.lit("no_text")).alias("status"))
    new = {"files": entries, "chunks": chunks, "sections": sections, "raw_refs": written(graph.extract_refs(sections), "refs"), "ref_keys": written(graph.listed_keys(sections), "ref-keys")}
    stored = store.names(corpus)
    if stored:
        new = {n: index_store.replaced(store.read(n, corpus), df, touched) for n, df in new.items() if n in stored}
    if {"ref_keys", "refs"} <= stored:
        new["refs"] = graph.propagate(store.read("refs", corpus), new["raw_refs"], store.read("ref_keys", corpus), new["ref_keys"], touched)
    else:  # the first build, or an index of before keys were stored
        new["ref_keys"] = new.get("ref_keys", graph.listed_keys(new["sections"]))
        new["refs"] = graph.resolve_by(new["raw_refs"], new["ref_keys"])
    store.commit(corpus, new)


def follow(
    spark: SparkSession, folder: str, corpus: str, root: str, checkpoint: str, embed: Callable[[Column], Column] | None = None,
    pdf_pages: Callable[[bytes], list[str]] | None = None, per_batch: int = 1000,
) -> None:
    """Index the files of a folder as a stream: all that came since the last run, ``per_batch`` files a commit.

    The checkpoint (a folder that driver and executors share) says which files each batch holds. A batch that
    died before its end comes again with the same files, and a commit replaces all rows of its files: after a crash, also one between a commit and its
    checkpoint, each file is there once. The stream takes each path once, whatever its time: files that changed or are
    gone are for a :func:`build`, which compares hashes; a build and a stream of one corpus must not run at once.
    """
    index_store.check_corpus(corpus)
    # fixed: the columns of Spark's reader of whole files
    stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile")
    stream = stream.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    stream = stream.option("maxFileAge", "36500d").load(folder)  # a file that comes late may be older than those that were read

    def put(batch: DataFrame, batch_id: int) -> None:
        store = index_store.IndexStore(batch.sparkSession, root)
        todo = written(files.parsed(files.eligible(files.entries(batch, folder, corpus)), pdf_pages), "texts")
        if todo.isEmpty():
            return
        chunks, sections = chunked(todo)
        chunks, sections = written(index_store.one_each(chunks, "chunks"), "chunks"), written(index_store.one_each(sections, "sections"), "sections")
        _put(store, corpus, todo, chunks, sections, todo.select("corpus", "path"), embed)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def skipped(spark: SparkSession, folder: str, corpus: str, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``corpus, path, ext, size, reason`` of the files of a folder that a build reads no text from."""
    rows = files.skipped(files.corpus_files(spark, folder, corpus)).select("corpus", "path", "ext", "size", "reason")
    if pdf_pages is None:
        paper = files.eligible(files.corpus_files(spark, folder, corpus)).filter("ext = '.pdf'")
        rows = rows.unionByName(paper.select("corpus", "path", "ext", "size", F.lit("no_reader").alias("reason")))
    return rows


def status(spark: SparkSession, root: str) -> DataFrame:
    """``corpus, table_name, n`` of the tables with rows."""
    store = index_store.IndexStore(spark, root)
    return index_store.stats({n: store.read(n) for n in ("files", "chunks", "sections", "refs")})


def purge(spark: SparkSession, root: str, corpus: str, path: str) -> None:
    index_store.IndexStore(spark, root).purge(spark.createDataFrame([(corpus, path)], "corpus string, path string"))


def primary_corpus(spark: SparkSession, root: str, preferred: str = "building-codes") -> str:
    """The corpus that is searched where none is named: the preferred one, else the first by name."""
    names = index_store.IndexStore(spark, root).corpora()
    if not names:
        raise FileNotFoundError(f"no corpus in {root}")
    return preferred if preferred in names else names[0]


def find(
    spark: SparkSession, root: str, queries: DataFrame, corpus: str | None = None, embed: Callable[[Column], Column] | None = None,
    synonyms: DataFrame | None = None, expand: bool = True, **options,
) -> DataFrame:
    """Search one corpus of a built index for a table of queries (``query_id, q``).

    Blank queries have no results. With ``synonyms`` (``word, instead``) and ``expand`` each query is also asked in its
    paraphrases, and all rankings are fused. A word of several terms (160D-1110) is searched as a phrase. ``top_k`` is clamped; further options are
    those of :func:`search.search`.
    """
    store = index_store.IndexStore(spark, root)
    corpus = corpus or primary_corpus(spark, root)
    asked = queries.select("query_id", X.stripped(X.text_of("q")).alias("q")).filter("q <> ''")
    if synonyms is not None and expand:
        asked = paraphrases(asked, synonyms)
    asked = written(asked.withColumn("embedding", (embed or hashed_vector())(F.col("q"))), "queries")
    chunks = store.read("chunks", corpus)
    index = store.inverted(corpus)
    options["top_k"] = clamped(options.get("top_k", PER_PROBE), options.get("balance", False))
    return search.search(
        asked, chunks, store.read("sections", corpus), store.read("refs", corpus), vectors=chunks.select("chunk_id", "embedding"),
        fulltext=lambda q, k: inverted.search(q, index, k).hits, **options,
    )


def with_sources(spark: SparkSession, root: str, results: DataFrame) -> DataFrame:
    """Results (of :func:`find`) with text, label and designation of their sections (or chunks, where there is no section)."""
    store = index_store.IndexStore(spark, root)
    corpus = results.select("corpus").distinct().collect()  # a few names
    corpus = corpus[0]["corpus"] if len(corpus) == 1 else None
    s = store.read("sections", corpus).select("corpus", "path", "section_id", "section_number", "section_title", "edition", "jurisdiction", "full_text")
    c = store.read("chunks", corpus).select("corpus", "chunk_id", F.col("text").alias("leaf"), F.col("edition").alias("leaf_edition"), F.col("jurisdiction").alias("leaf_jurisdiction"), "page")
    rows = results.join(s, ["corpus", "path", "section_id"], "left").join(c, ["corpus", "chunk_id"], "left")
    rows = rows.withColumn("text", F.coalesce(F.nullif("full_text", F.lit("")), "leaf")).withColumn("source_file", X.basename("path"))
    rows = rows.withColumn("edition", F.coalesce("edition", "leaf_edition")).withColumn("jurisdiction", F.coalesce("jurisdiction", "leaf_jurisdiction"))
    args = ("edition", "jurisdiction", "source_file", "section_number", "section_title", "page")
    return rows.withColumn("label", A.chunk_label("path", *args, referenced_by="referenced_by")).withColumn("designation", A.designation(*args))


def clamped(top_k: int, balance: bool = False, least: int = 1, most: int = 20) -> int:
    """How many sections a question may ask for; a balanced search has 15 at least. Tools ask for ``least`` 3."""
    top_k = max(least, min(top_k, most))
    return max(top_k, 15) if balance else top_k


def answer(queries: DataFrame, sources: DataFrame, chat: Chat, instruction: str = "Answer from the excerpts and cite them.") -> DataFrame:
    """``query_id, answer, citations, authorities, status, refused, refusal_reason`` for each query; ``sources`` are ranked sections."""
    numbered = F.array_sort(F.collect_list(F.struct("rank", "label", "text", "designation")))
    per = sources.groupBy("query_id").agg(numbered.alias("c"), F.first("status").alias("status"))
    rows = queries.select("query_id", "q").join(per, "query_id", "left")
    rows = rows.withColumn("status", F.coalesce("status", F.lit("no_results"))).withColumn("n", F.coalesce(F.size("c"), F.lit(0)))
    none = F.array().cast(ArrayType(StringType()))
    pick = lambda f: F.coalesce(F.transform("c", lambda x: x[f]), none)
    block = A.context_block(pick("label"), pick("text"), A.query_terms("q"))
    rows = rows.withColumn("designations", pick("designation"))
    rows = rows.withColumn("prompt", F.concat(F.lit(instruction + "\n\nQuestion: "), "q", F.lit("\n\nExcerpts (numbered):\n"), block)).drop("c")
    rows = replies(rows, chat).withColumn("citations", A.citations("reply", F.col("n")).cast(ArrayType(IntegerType())))
    reason = A.refusal(F.col("status"), "reply", F.col("citations"), REFUSAL)
    return rows.select(
        "query_id", F.when(reason.isNull(), F.col("reply")).otherwise(REFUSAL).alias("answer"), "citations",
        F.transform("citations", lambda k: F.element_at("designations", k)).alias("authorities"), "status",
        reason.isNotNull().alias("refused"), reason.alias("refusal_reason"), F.col("reply"),
    )


def planned(questions: DataFrame, chat: Chat) -> DataFrame:
    """``question_id, cleaned_query, probes`` of questions (``query_id, q``): what the provider says as JSON, or the question itself."""
    said = replies(questions.select("query_id", "q", F.concat(F.lit(PLAN + "\n\nQuestion: "), "q").alias("prompt")), chat)
    plan = A.loads_json("reply")
    text = F.nullif(X.stripped(X.text_of(F.try_variant_get(plan, "$.cleaned_query", "string"))), F.lit(""))
    some = lambda name: F.coalesce(F.try_variant_get(plan, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    probes = F.when(text.isNotNull(), F.concat(some("search_queries"), some("rules_to_check"))).otherwise(F.array().cast("array<string>"))
    return said.select(F.col("query_id").alias("question_id"), F.coalesce(text, X.text_of("q")).alias("cleaned_query"), probes.alias("probes"))


def retrieve(spark: SparkSession, root: str, plans: DataFrame, extras: DataFrame | None = None, top_k: int = 15, per_probe: int = PER_PROBE, **options) -> DataFrame:
    """Sections of planned questions: all probes of all questions are one search, and their rankings are fused.

    ``extras`` (``question_id, extra``) are probes that are asked in any case. Paraphrases are asked for questions without probes only.
    """
    none = F.array().cast("array<string>")
    if extras is not None:
        plans = plans.join(extras.groupBy("question_id").agg(F.array_sort(F.collect_set("extra")).alias("extras")), "question_id", "left")
        plans = plans.withColumn("extras", F.coalesce("extras", none))
    else:
        plans = plans.withColumn("extras", none)
    asked = written(search.probes(plans).join(plans.select("question_id", (F.size("probes") == 0).alias("bare")), "question_id"), "probes")
    results = None
    for bare in (True, False):
        queries = asked.filter(F.col("bare") == bare).select(F.struct("question_id", "probe_no").alias("query_id"), F.col("probe").alias("q"))
        found = find(spark, root, queries, top_k=per_probe, expand=bare, **options)
        results = found if results is None else results.unionByName(found)
    per = results.select(F.col("query_id.question_id").alias("question_id"), F.col("query_id.probe_no").alias("probe_no"), *[c for c in results.columns if c != "query_id"])
    return search.fuse_probes(per, top_k).withColumnRenamed("question_id", "query_id").drop("rrf")


def reason(spark: SparkSession, root: str, questions: DataFrame, chat: Chat, top_k: int = 15, rounds: int = ROUNDS, **options) -> DataFrame:
    """Answers to questions (``query_id, q``): planned, searched by probes, and searched again for up to ``rounds`` replies that are a ``NEED:`` line.

    Probes of all questions are rows of one search; what a round finds joins the working set, each section once.
    """
    top_k = clamped(top_k, options.get("balance", False))
    plans = written(planned(questions, chat), "plans")
    held = written(with_sources(spark, root, retrieve(spark, root, plans, top_k=top_k, **options)), "sources")
    for _ in range(rounds):
        said = written(answer(questions, held, chat), "answers")
        need = written(said.select(F.col("query_id").alias("question_id"), A.need_probe("reply").alias("extra")).filter("extra is not null"), "needs")
        if need.isEmpty():
            return said.drop("reply")
        more = with_sources(spark, root, retrieve(spark, root, plans.join(need, "question_id", "left_semi"), need, top_k=top_k, **options))
        new = more.join(held.select("query_id", "corpus", "path", "section_id"), ["query_id", "corpus", "path", "section_id"], "left_anti")
        every = held.withColumn("round", F.lit(0)).unionByName(new.withColumn("round", F.lit(1)))
        order = W.partitionBy("query_id").orderBy("round", "rank", "section_id")
        held = written(every.withColumn("rank", F.row_number().over(order)).drop("round"), "sources")
    return answer(questions, held, chat).drop("reply")


def register(spark: SparkSession) -> None:
    """SQL functions: ``sanitize_ascii``, ``short_codes``, ``parse_citations`` and the table function ``chunk_text``."""
    from pyspark.sql.functions import udtf

    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION parse_citations(a STRING, n INT) RETURNS ARRAY<INT> RETURN
      array_sort(array_distinct(filter(transform(flatten(transform(regexp_extract_all(a, r'\[\s*(\d+(?:\s*,\s*\d+)*)\s*\]', 1), x -> split(x, r'\s*,\s*'))), x -> try_cast(x AS INT)), x -> x BETWEEN 1 AND n)))""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION short_codes(q STRING) RETURNS ARRAY<STRING> RETURN
      filter(transform(split(q, r'[\s,;:()\[\]{}/]+'), t -> regexp_replace(t, '^[.\\-\'"]+|[.\\-\'"]+$', '')), t -> t rlike '^[A-Z0-9]{2,8}$' AND t rlike '[A-Z]' AND t rlike '[0-9]')""")
    spark.sql(r"""CREATE OR REPLACE TEMPORARY FUNCTION sanitize_ascii(t STRING) RETURNS STRING RETURN
      regexp_replace(regexp_replace(replace(replace(translate(coalesce(t, ''), '‘’“”–• ', '\'\'""-- '), '—', '--'), '…', '...'), r'[\x00-\x08\x0b\x0c\x0e-\x1f]', ''), r'[^\x00-\x7E]', '?')""")

    @udtf(returnType="start int, end int, piece string")
    class ChunkText:
        def eval(self, text: str):
            yield from chunking.windows(text or "")

    spark.udtf.register("chunk_text", ChunkText)
