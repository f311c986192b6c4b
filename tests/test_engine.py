"""The life of an index from a folder to cited answers."""

import pytest
from pyspark.sql import functions as F

from spindrift import engine, providers
from spindrift.operators import index_store, inverted, search

CODE = """<html><body><section id="C_SecR105"><span class="tg-number">R105</span><span class="tg-title">Permits</span><p>A permit is needed to build a shed. See Section 101.2.</p>
<section id="C_SecR105.2"><span class="tg-title">Exempt work</span><p>Sheds below two hundred square feet need no permit, under N.C.G.S. 160D-1110.</p></section></section>
<section id="C_Sec101.2"><span class="tg-number">101.2</span><span class="tg-title">Scope</span><p>This code rules the building of dwellings and of sheds.</p></section></body></html>"""


@pytest.fixture
def folder(tmp_path):
    for name, text in {"model/2024/irc/ch1.html": CODE, "north-carolina/NCBC2024/law.html": CODE.replace("C_Sec", "D_Sec").replace("shed", "barn").replace("Shed", "Barn"), "durham/notes.txt": "Fences of any height need a zoning check before work begins.\n" * 80}.items():
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True)
        path.write_text(text)
    return tmp_path


def test_build_search_answer(spark, folder):
    docs, root = str(folder / "docs"), str(folder / "index")
    assert engine.build(spark, docs, "codes", root, dry_run=True).first()["files"] == 3 and not (folder / "index").exists()
    engine.build(spark, docs, "codes", root)
    counts = {r.table_name: r.n for r in engine.status(spark, root).collect()}
    assert counts["files"] == 3 and counts["sections"] == 6 and counts["chunks"] == 8
    assert engine.build(spark, docs, "codes", root).first()["files"] == 0  # nothing changed

    q = spark.createDataFrame([(1, "shed below two hundred square feet"), (2, "zoning fences")], "query_id long, q string")
    found = engine.with_sources(spark, root, engine.find(spark, root, q, top_k=3))
    top = {r.query_id: r for r in found.filter("rank = 1").collect()}
    assert top[1].section_id.endswith("C_SecR105.2") and "two hundred" in top[1].text and top[2].path == "durham/notes.txt"
    only = engine.find(spark, root, q, top_k=8, filters=search.Filters(location="model"))
    assert {r.path.split("/")[0] for r in only.collect()} == {"model"}

    plan = '```json\n{"cleaned_query": "zoning fences", "search_queries": ["sheds of two hundred square feet", "zoning fences"], "rules_to_check": []}\n```'

    def chat(prompts):
        said = []
        for p in prompts:
            if "Plan the search" in p:
                said.append(plan if "zoning fences" in p else "no plan")
            else:
                said.append("NEED: zoning fences" if "two hundred" in p and "Fences" not in p else "Yes [1], and [9].")
        return said

    plans = {r.question_id: r for r in engine.planned(q, chat).collect()}
    assert plans[1].cleaned_query == "shed below two hundred square feet" and plans[1].probes == []
    assert plans[2].probes == ["sheds of two hundred square feet", "zoning fences"]
    fused = engine.retrieve(spark, root, spark.createDataFrame(list(plans.values())), top_k=9)
    assert {r.path for r in fused.filter("query_id = 2").collect()} >= {"durham/notes.txt", "model/2024/irc/ch1.html"}

    got = {r.query_id: r for r in engine.answer(q, found.filter("rank = 1"), chat).collect()}
    assert got[2].citations == [1] and not got[2].refused and got[2].authorities[0].endswith("notes.txt")
    assert got[1].refused and got[1].refusal_reason == "no_citations"
    loop = {r.query_id: r for r in engine.reason(spark, root, q, chat, top_k=1).collect()}
    assert loop[1].citations == [1] and not loop[1].refused

    synonyms = spark.createDataFrame([("enclosures", "fences")], "word string, instead string")
    lay = spark.createDataFrame([(7, "enclosures")], "query_id long, q string")
    plain, wide = (engine.find(spark, root, lay, synonyms=x, top_k=2).filter("rank = 1").first() for x in (None, synonyms))
    assert wide.path == "durham/notes.txt" and (plain is None or plain.score < wide.score)
    assert engine.find(spark, root, spark.createDataFrame([(1, "  "), (2, None)], "query_id long, q string")).count() == 0

    (folder / "docs/durham/notes.txt").unlink()
    (folder / "docs/model/2024/irc/ch1.html").write_text(CODE.replace("two hundred", "three hundred"))
    assert engine.build(spark, docs, "codes", root).first()["files"] == 1
    assert {r.table_name: r.n for r in engine.status(spark, root).collect()}["files"] == 2


def test_corpora_types_and_last_rows(spark, tmp_path):
    """A folder without sections, two corpora with equal paths, PDF files with and without a reader, a limit, and the purge of the last file."""
    for corpus, word in (("left", "barns"), ("right", "sheds")):
        (tmp_path / corpus).mkdir()
        (tmp_path / corpus / "a.txt").write_text(f"All {word} of the county need a permit before work begins.\n" * 3)
    (tmp_path / "right/b.pdf").write_bytes(b"%PDF")
    root = str(tmp_path / "index")
    for corpus in ("left", "right"):
        engine.build(spark, str(tmp_path / corpus), corpus, root)
    assert {(r.corpus, r.table_name, r.n) for r in engine.status(spark, root).collect()} == {("left", "files", 1), ("left", "chunks", 1), ("right", "files", 2), ("right", "chunks", 1)}
    assert [(r.path, r.reason) for r in engine.skipped(spark, str(tmp_path / "right"), "right").collect()] == [("b.pdf", "no_reader")]
    q = spark.createDataFrame([(1, "barns or sheds of the county")], "query_id long, q string")
    for corpus, word in (("left", "barns"), ("right", "sheds")):
        got = engine.with_sources(spark, root, engine.find(spark, root, q, corpus)).collect()
        assert len(got) == 1 and word in got[0].text and got[0].corpus == corpus
    assert engine.primary_corpus(spark, root) == "left" and engine.primary_corpus(spark, root, "right") == "right"

    def pages(content):
        return ["A page about sheds made of wood, and of the permit.", "Another page about barns made of stone."]

    assert engine.build(spark, str(tmp_path / "right"), "right", root, full=True, limit=1).first()["files"] == 1
    engine.build(spark, str(tmp_path / "right"), "right", root, full=True, pdf_pages=pages)
    got = engine.with_sources(spark, root, engine.find(spark, root, spark.createDataFrame([(1, "barns stone")], "query_id long, q string"), "right", top_k=1)).first()
    assert got.path == "b.pdf" and got.label.endswith("p.2") and got.section_id == "b.pdf#p2"
    for corpus, path in (("left", "a.txt"), ("right", "a.txt")):
        engine.purge(spark, root, corpus, path)
    assert {(r.corpus, r.table_name, r.n) for r in engine.status(spark, root).collect()} == {("right", "files", 1), ("right", "chunks", 2)}
    assert engine.find(spark, root, q, "left").count() == 0
    (tmp_path / "none").mkdir()
    engine.build(spark, str(tmp_path / "none"), "none", root)
    assert engine.find(spark, root, q, "none").count() == 0


def test_purge_drops_raw_references(spark, folder):
    docs, root = str(folder / "docs"), str(folder / "index")
    engine.build(spark, docs, "codes", root)
    store = index_store.IndexStore(spark, root)
    assert store.read("raw_refs").select("path").distinct().count() == 2
    engine.purge(spark, root, "codes", "model/2024/irc/ch1.html")
    for table in ("raw_refs", "refs", "chunks", "sections"):
        assert {r.path for r in store.read(table).select("path").distinct().collect()} <= {"north-carolina/NCBC2024/law.html", "durham/notes.txt"}
    assert store.read("refs").filter("dst_path = 'model/2024/irc/ch1.html'").count() == 0


def test_only_changed_files_are_parsed_and_codes_are_phrases(spark, tmp_path):
    """Calls of the PDF reader over four builds; the parts of a code elsewhere are no hits of the code; two writers at once leave one whole state."""
    docs, calls, root = tmp_path / "docs", tmp_path / "calls", str(tmp_path / "index")
    for d in (docs, calls):
        d.mkdir()
    for name, body in {"a.pdf": "Rules of section 160D-1110 on sheds.", "b.pdf": "Part 160D of the law, and page 1110 of it.", "c.txt": "Nothing on this."}.items():
        (docs / name).write_text(body)

    def pages(content):
        with open(f"{calls}/{hash(content)}", "a") as f:
            f.write("x")
        return [content.decode()]

    def built():
        before = sum(len(f.read_text()) for f in calls.iterdir())
        n = engine.build(spark, str(docs), "codes", root, pdf_pages=pages).first()["files"]
        return n, sum(len(f.read_text()) for f in calls.iterdir()) - before

    assert built() == (3, 2) and built() == (0, 0)
    (docs / "b.pdf").write_text("Part 160D of the law, and page 1110 of the same.")
    assert built() == (1, 1)
    store = index_store.IndexStore(spark, root)
    q = spark.createDataFrame([(1, "160D-1110")], "query_id long, q string")
    words = inverted.search(q, store.inverted("codes"), 5)
    assert [store.read("chunks").filter(F.col("chunk_id") == r.chunk_id).first().path for r in words.hits.collect()] == ["a.pdf"]
    assert inverted.search(q, store.inverted("codes"), 5, phrases=False).hits.count() == 2
    assert engine.find(spark, root, q, top_k=99).first().path == "a.pdf"

    other, first = index_store.IndexStore(spark, root), {"files": store.read("files", "codes")}
    current = store._current()
    other._current = lambda: current  # has looked before the first one's commit
    store.commit("codes", first)
    other.commit("codes", first)
    assert store.read("files").count() == 3 == other.read("files").count()
    (docs / "a.pdf").unlink()
    assert built() == (0, 0) and {r.path for r in store.read("files").collect()} == {"b.pdf", "c.txt"}


def test_top_k_is_clamped():
    assert [engine.clamped(k) for k in (-1, 5, 99)] == [1, 5, 20] and engine.clamped(3, balance=True) == 15 and engine.clamped(1, least=3) == 3


def test_requests_are_halved_and_retried():
    calls, naps = [], []

    def call(texts):
        calls.append(len(texts))
        if len(texts) > 60:
            raise providers.Overloaded
        if len(calls) == 4:
            raise OSError
        return [t.upper() for t in texts]

    texts = [f"t{k}" for k in range(300)]
    assert providers.batched(call, texts, naps.append) == [t.upper() for t in texts] and naps == [1.0]


def test_paraphrases(spark):
    q = spark.createDataFrame([(1, "build a shed"), (2, "none")], "query_id long, q string")
    s = spark.createDataFrame([("shed", "accessory building"), ("build", "erect")], "word string, instead string")
    got = {(r.query_id, r.variant): r.q for r in providers.paraphrases(q, s).collect()}
    assert got == {(1, 0): "build a shed", (1, 1): "build a accessory building", (1, 2): "erect a shed", (2, 0): "none"}


def test_sql_functions(spark):
    engine.register(spark)
    row = spark.sql("SELECT sanitize_ascii('“é”') a, short_codes('see R705, NC') b, parse_citations('x [2, 1] [9]', 3) c").first()
    assert (row.a, row.b, row.c) == ('"?"', ["R705"], [1, 2])
    assert spark.sql("SELECT count(*) n FROM chunk_text(repeat('word and more. ', 400))").first().n == 3
    assert spark.range(2).select(providers.hashed_vector(8)(F.lit("a b c"))).distinct().count() == 1
