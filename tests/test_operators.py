"""What the given tables cannot reach: section trees, page lists, windows, references, answers, the store and streams."""

import re
import io
import math
import random
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spindrift.functions import answers as A, facets, text as X
from spindrift.operators import chunking, evaluate, graph, index_store, search
from spindrift.session import written
from spindrift.settings import Settings
from spindrift.sources import files, html
from spindrift.streaming import logs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


PAGE = """<html><head><meta name="book" content="B &amp; C"></head><body><section id="X_SecA"><span class="tg-number">A</span><span class="tg-title">Alpha</span><p>a text</p>
<section id="X_SecA1"><p>a1</p><table><tr><th>h</th><th>i</th></tr><tr><td>1</td></tr></table></section><section id="X_SecA2"><p>a2</p></section></section>
<section id="X_SecR101.2.1"><p>b</p><section id="B1"><p>b1</p></section></section><section><p>no id</p></section><script>x</script></body></html>"""


def test_section_tree_is_in_document_order(spark):
    df = spark.createDataFrame([("c", "p", PAGE)], "corpus string, path string, html string")
    rows = df.select("corpus", "path", F.explode(html.section_tree("html")).alias("s")).select("corpus", "path", "s.*")
    got = {r.section_id: r for r in graph.rolled_up(rows, graph.trails(rows)).collect()}
    assert [r.section_id for r in sorted(got.values(), key=lambda r: r.ord)] == ["X_SecA", "X_SecA1", "X_SecA2", "X_SecR101.2.1", "B1"]
    assert got["X_SecA"].full_text == "A\nAlpha\na text\n\na1\n| h | i |\n| --- | --- |\n| 1 | |\n\na2"
    assert (got["X_SecA"].section_number, got["X_SecA"].section_title, got["X_SecR101.2.1"].section_number) == ("A", "Alpha", "R101.2.1")
    assert got["X_SecA1"].has_table and not got["X_SecA2"].has_table and got["X_SecA1"].parent_section_id == "X_SecA"
    crumbs = {r.section_id: r.breadcrumb for r in graph.breadcrumbs(graph.trails(rows)).collect()}
    assert crumbs["X_SecA2"] == "A Alpha > A2"
    kinds = {r.section_id: r.node_type for r in chunking.chunk_sections(with_place(rows).withColumn("own_text", F.rpad("own_text", 40, "."))).collect()}
    assert kinds["X_SecA1"] == "table" and kinds["B1"] == "leaf"
    assert df.select(html.flat_text(F.lit("<p>x</p><table><tr><td>a</td></tr></table>")).alias("t")).first().t == "x\n| a |\n| --- |"


def with_place(rows):
    return rows.withColumns({"breadcrumb": F.lit(""), "edition": F.lit("E"), "jurisdiction": F.lit("model")})


def test_breadcrumb_cycles_and_missing_parents(spark):
    rows = [("a", "b", "1", "A"), ("b", "a", "2", "B"), ("c", "zz", "3", None), ("d", "c", None, None)]
    df = spark.createDataFrame(rows, "section_id string, parent_section_id string, section_number string, section_title string")
    got = {r.section_id: r.breadcrumb for r in graph.breadcrumbs(graph.trails(df)).collect()}
    assert got == {"a": "2 B > 1 A", "b": "1 A > 2 B", "c": "3", "d": "3"}


@settings(max_examples=60, deadline=None)
@given(st.text("ab .\n!", max_size=900), st.integers(40, 200))
def test_windows_cover_the_text(text, size):
    spans = chunking.windows(text, size, size // 8)
    assert all(e - s <= size for s, e, _ in spans)
    at = 0
    for s, e, piece in spans:
        assert not text[at:s].strip() and (piece == text or piece == text[s:e].strip())
        at = e
    assert not text[at:].strip()


def test_window_boundaries():
    assert [len(w[2]) for w in chunking.windows("x" * 3200)] == [3200]
    assert [(s, e) for s, e, _ in chunking.windows("x" * 3201)] == [(0, 3200), (2800, 3201)]
    text = "a" * 3050 + "\n\n" + "b. " * 600
    assert chunking.windows(text)[0][1] == 3052
    assert chunking.windows("c" * 3100 + ". " + "d" * 3000)[0][1] == 3102
    assert chunking.windows("c" * 3100 + " " + "d" * 3000)[0][1] == 3101


def test_page_sections(spark):
    body = [f"{n} Title of it\nwords of section {n}\nas in\n112.1 comply" for n in (101, 102, 103, "103.1", "103.2", 104)]
    back = ["102.9 Backwards title\ntext"]
    schema = "corpus string, path string, pages array<string>"
    df = spark.createDataFrame([("c", "model/2021_International_Building_Code.pdf", [*body[:4], *back, *body[4:]]), ("c", "x.pdf", ["Only one page with text in it", "", "tiny"])], schema)
    leaves, nodes = chunking.chunk_pages(df)
    got = {r.section_number: r for r in nodes.collect()}
    assert set(got) == {"101", "102", "103", "103.1", "103.2", "104"}
    assert got["103.2"].parent_section_id.endswith("#103") and got["103"].parent_section_id is None and got["103.1"].page == 4
    assert "102.9 Backwards" in got["103.1"].own_text and got["101"].edition == "IBC 2021"
    assert [r.section_id for r in leaves.filter("path = 'x.pdf'").collect()] == ["x.pdf#p1"]


def test_bm25_in_blocks_shuffles_no_pairs(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))
    chunks = spark.createDataFrame([(i, text(i % 13), text(i % 3)) for i in range(150)] + [(i, "ax ax bx", None) for i in range(150, 180)], "chunk_id long, text string, meta string")
    queries = spark.createDataFrame([(i, text(1 + i % 4) if i else "none") for i in range(23)], "query_id long, q string")
    index = search.postings(chunks, meta_col="meta")
    got = {}
    for size in (1 << 20, 5):
        for name in ("TERM_BLOCK", "HIT_BLOCK", "QUERY_BLOCK", "PRODUCTS"):
            monkeypatch.setattr(search, name, size)
        hits = search.bm25(queries, index, k=7)
        assert "query_id" in (plan := hits._jdf.queryExecution().toString()) and "hashpartitioning(query_id#" in plan
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)  # what is shuffled are the k best of each block
        got[size] = sorted(map(tuple, hits.collect()))
    counts = {r.chunk_id: [r.t.count(w) + 0.3 * r.m.count(w) for w in sorted(a + b for a in "abcdefgh" for b in "xyz")] for r in index.collect()}
    sizes = {r.chunk_id: r.len for r in index.collect()}
    words, avg = sorted(a + b for a in "abcdefgh" for b in "xyz"), sum(sizes.values()) / len(sizes)
    df = [sum(c[i] > 0 for c in counts.values()) for i in range(len(words))]
    want = []
    for query, q in queries.collect():
        s = {}
        for c, tf in counts.items():
            parts = [max(math.log((180 - df[i] + 0.5) / (df[i] + 0.5)), 1e-6) * tf[i] * 2.2 / (tf[i] + 1.2 * (0.25 + 0.75 * sizes[c] / avg)) for i in map(words.index, q.split() if q != "none" else []) if tf[i]]
            if parts:
                s[c] = round(sum(parts), 9)
        want += [(query, c, s[c], n) for n, c in enumerate(sorted(s, key=lambda c: (-s[c], c))[:7], 1)]
    for rows in got.values():
        assert [r[:2] + r[3:] for r in rows] == sorted(r[:2] + r[3:] for r in want) and [r[2] for r in rows] == pytest.approx([r[2] for r in sorted(want)])
    totals = {r.term: (r.df, r.total) for r in search.term_counts(index).collect()}
    assert totals == {w: (d, pytest.approx(sum(c[i] for c in counts.values()))) for i, (w, d) in enumerate(zip(words, df)) if d}


def test_chunk_texts_bounds_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    files_ = spark.createDataFrame([("c", "a/b.txt", "l", "word " * 2000)], "corpus string, path string, label string, text string")
    assert chunking.chunk_texts(files_).count() > 1 and int(spark.conf.get(key)) <= 1000


def test_references_without_semicolon(spark, tmp_path):
    cut = "<p>ver&amp</p> a&ampx; &amp;copy &amp;lt;&#9731;&amp;amp;"
    assert one(spark, X.strip_tags("t", closed=True), t=cut) == "ver&amp a&ampx; &copy <\u2603&"
    assert one(spark, X.strip_tags("t"), t=cut) == "ver& a&x; \u00a9 <\u2603&"
    assert one(spark, X.clean_lines("t", closed=True), t=cut) == "<p>ver&amp</p> a&ampx; &copy &lt;\u2603&amp;"


def test_text_functions(spark):
    assert one(spark, X.sanitize_ascii("t"), t="‘a’ “b” — – … • c\x01\x7f\U0001f600é\t") == "'a' \"b\" -- - ... - c??" + "?\t"
    assert one(spark, X.sanitize_ascii("t"), t=None) == ""
    assert one(spark, X.human_size("n"), n=1536) == "1 KB" and one(spark, X.human_size("n"), n=1_572_864) == "1.5 MB"
    assert one(spark, X.number_parts("t"), t="R101.2.1") == [101, 2, 1] and one(spark, X.number_parts("t"), t="A.b") is None
    assert tuple(one(spark, X.split_heading("t"), t="§ 160D-1110. Building permits ")) == ("160D-1110", "Building permits")
    assert tuple(one(spark, X.split_heading("t"), t="General words")) == (None, "General words")
    assert one(spark, X.short_codes("t"), t="R705 in Durham, NC for $20,000 (160D-1110) 'A1'.") == ["R705", "A1"]
    assert one(spark, X.safe_name("t"), t="../a b/c d?.pdf") == "c_d_.pdf"
    assert one(spark, X.source_label("t"), t="2024 North Carolina State Building Code: Fire Code ") == "NC 2024 Fire Code" and one(spark, X.source_label("t"), t="x: y") == "x: y"
    assert one(spark, X.extension("t"), t="A.B.PDF") == ".pdf" and one(spark, X.extension("t"), t=".hidden") == ""
    assert one(spark, X.html_meta("t", "book"), t=PAGE) == "B & C"
    assert one(spark, X.clean_lines("t"), t="a &amp;  b&#10;\n &eacute;&nbsp;") == "a & b\né"
    assert one(spark, X.strip_tags("t"), t="<b>a &amp;lt; b</b>") == "a < b"
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "c binary")
    assert [r.x for r in df.select(X.decode_text(F.col("c")).alias("x")).collect()] == ["é", "é"]
    doc = b"\x00\x01" + b"Readable words that are long enough here" + b"\x02\x03\x80" + b"1234567890 1234567890 12" + b"\xff"
    got = spark.createDataFrame([(bytearray(doc),)], "c binary").select(X.legacy_doc_text(F.col("c")).alias("x")).first().x
    assert got.endswith("\n\nReadable words that are long enough here")


def test_facets(spark):
    cases = {
        "model/2024/ibc/x.html": ("model", "ibc", "2024", "IBC (model)"),
        "model/2021_International_Building_Code.pdf": ("model", "ibc", "2021", "IBC (model)"),
        "north-carolina/NCBC2024/a.html": ("north-carolina", "ncbc", "2024", "NC Building Code"),
        "durham/inspections/udo-x.html": ("durham", "udo", "2019", "Durham UDO"),
        "graham/zoning-code_2020.pdf": ("graham", "zoning-code-2020", "2020", "City of Graham — Zoning Code 2020"),
        "federal/ada/x.html": ("federal", "ada", "2019", "Ed"),
        "file.pdf": ("file.pdf", "file.pdf", "2019", "Ed"),
    }
    df = spark.createDataFrame([(p, "Ed 2019") for p in cases], "path string, edition string")
    for r in df.select("path", facets.facet("path", "edition").alias("f")).collect():
        assert (r.f.jurisdiction, r.f.family, r.f.year, r.f.doc_label) == cases[r.path]
    assert one(spark, facets.tier("t"), t="alamance-towns") == "local-alamance-towns" and one(spark, facets.tier("t"), t="x") == "other"
    assert one(spark, facets.location_allows("t", F.lit("durham")), t="nowhere") is True
    assert one(spark, facets.location_allows("t", F.lit("durham")), t="Model") is False


def test_references_resolve_by_preference(spark):
    s = [("c", "f", "a", "101.2", "text"), ("c", "g", "b", "101.2", "text"), ("c", "f", "d", "R5.1", "self"), ("c", "g", "e", "7.7", "says 160D-1110 in a long section"), ("c", "f", "z", "9", "160D-1110")]
    sections = spark.createDataFrame(s, "corpus string, path string, section_id string, section_number string, full_text string")
    r = [("c", "g", "e", "101.2", "internal_section"), ("c", "f", "d", "R101.2", "internal_section"), ("c", "f", "d", "R5.1", "internal_section"), ("c", "f", "a", "1.1", "internal_section"), ("c", "f", "a", "160D-1110", "ncgs")]
    refs = spark.createDataFrame(r, "corpus string, path string, src_section_id string, dst_raw string, dst_kind string")
    got = {(x.src_section_id, x.dst_raw): x.dst_section_id for x in graph.resolve_refs(refs, sections).collect()}
    assert got == {("e", "101.2"): "b", ("d", "R101.2"): "a", ("d", "R5.1"): None, ("a", "1.1"): None, ("a", "160D-1110"): "e"}


def test_first_two_of_a_hot_key(spark):
    rows = [("c", -10 - k % 7, f"s{k}", "160D-1110") for k in range(50)] + [("c", -9, "s1", "160D-1110"), ("c", -5, "x", "14-7A")]
    said = spark.createDataFrame(rows, "corpus string, less int, s_id string, dst_raw string").select("corpus", "dst_raw", F.struct("less", "s_id").alias("x"))
    got = {r.dst_raw: [x.s_id for x in r.two] for r in graph.first_two(said, ["corpus", "dst_raw"], "t").collect()}
    assert got == {"14-7A": ["x"], "160D-1110": ["s13", "s20"]}


def _resolved_plainly(refs, sections):
    """As it is stated: one reference after the other, over all sections."""
    out = {}
    for path, src, raw, kind in refs:
        rows = sorted(sections)
        if kind == "ncgs":
            hits = [(-len(t), p, i) for p, i, _, t in rows if raw.lower() in t.lower() and (p, i) != (path, src)]
            out[src, raw] = min(hits)[2] if hits else None
            continue
        listed = lambda n: [(p, i) for p, i, num, _ in rows if num and n in (num, re.sub("^[A-Z]+", "", num))]
        found = [x for x in listed(raw) or listed(raw.lstrip("R")) if x != (path, src)]
        same = [x for x in found if x[0] == path]
        out[src, raw] = (same or found or [(None, None)])[0][1]
    return out


def test_resolution_equals_the_plain_rules(spark):
    numbers = ["R105.2", "105.2", "105", "B7.1", "7.1", None, "R7.1", "AR105.2", "9"]
    texts = ["see 160d-1110.15 here", "under 160D-1110", "160D-111", "1160D-1110", "no statute 12-3", "12-34-56 and 112A-5.", ""]
    sections = [(f"f{k % 3}", f"s{k}", numbers[k % len(numbers)], texts[k % len(texts)] * (1 + k % 2)) for k in range(40)]
    raws = ["R105.2", "105.2", "7.1", "R7.1", "RR105", "404.1", "105"]
    statutes = ["160D-1110", "160D-11", "60D-1110", "34-56", "112A-5", "12A-5", "160D-1110.1", "99A-1"]
    refs = [(p, i, r, "internal_section") for k, (p, i, _, _) in enumerate(sections) for r in (raws[k % 7], raws[(k + 3) % 7])]
    refs += [(p, i, statutes[k % 8], "ncgs") for k, (p, i, _, _) in enumerate(sections)]
    s = spark.createDataFrame([("c", *x) for x in sections] + [("other", "f0", "s999", "404.1", "99A-1")], "corpus string, path string, section_id string, section_number string, full_text string")
    r = spark.createDataFrame([("c", *x) for x in refs], "corpus string, path string, src_section_id string, dst_raw string, dst_kind string")
    got = {(x.src_section_id, x.dst_raw): x.dst_section_id for x in graph.resolve_refs(r, s).collect()}
    assert got == _resolved_plainly(refs, sections) and any(got.values())


def _robin(rows, most):
    groups, out = {}, []
    for g, p in rows:
        groups.setdefault(g, []).append(p)
    queues = list(groups.values())
    while queues and len(out) < most:
        for q in queues:
            if q and len(out) < most:
                out.append(q.pop(0))
        queues = [q for q in queues if q]
    return out


def test_stratified_pool_is_round_robin(spark):
    r = random.Random(3)
    rows, want = [], {}
    for q in range(25):
        mine = [(r.choice("abc"[: q % 3 + 1]), p) for p in range(r.randint(1, 30))]
        want[q] = _robin(mine, 12)
        rows += [(q, p, g) for g, p in mine]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, g string")
    got = {}
    for x in search.stratified(df, F.col("g"), F.col("chunk_id"), 12).orderBy("query_id", "pool_pos").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    assert got == want


def test_bm25_by_hand(spark):
    docs = [(1, "cat sat", ""), (2, "cat cat dog", "cat"), (3, "dog", ""), (4, "bird of prey", ""), (5, "fish", "")]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string, meta string")
    q = spark.createDataFrame([(1, "Cat cat"), (2, "dög")], "query_id long, q string")
    got = {(r.query_id, r.chunk_id): r.score for r in search.bm25(q, search.postings(chunks, meta_col="meta"), search.corpus_stats(chunks, meta_col="meta"), 10).collect()}
    import math

    idf, avg = math.log((5 - 2 + 0.5) / 2.5), 11 / 5
    part = lambda tf, n: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    assert got == {(1, 1): pytest.approx(2 * part(1, 2)), (1, 2): pytest.approx(2 * part(2.3, 4)), (2, 2): pytest.approx(part(1, 4)), (2, 3): pytest.approx(part(1, 1))}


def test_knn_blocks_and_fusion(spark):
    r = random.Random(1)
    rows = [(k, [r.random() for _ in range(4)]) for k in range(60)] + [(99, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    q = v.filter("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    by = lambda df: {(x.query_id, x.rank): x.chunk_id for x in df.collect()}
    assert by(search.knn(q, v, 5)) == by(search.knn(q, v, 5, block=3))
    assert all(c == k for (k, rank), c in by(search.knn(q, v, 1)).items())
    assert search.knn(q.limit(0), v).count() == 0
    a, b = search.knn(q, v, 5), search.knn(q, v, 3)
    score = lambda *lists: {(x.query_id, x.chunk_id): x.rrf for x in search.fuse(lists).collect()}
    assert score(a, b) == score(b, a)


def test_filters_and_short_codes(spark):
    assert one(spark, F.col("t").rlike(search.glob_pattern("a*[xy]?.html")), t="a/b/xz.html") and not one(spark, F.col("t").rlike(search.glob_pattern("*.htm")), t="a.html")
    rows = spark.createDataFrame([(1, "see R705 now", "R705"), (1, "R7051", "R705"), (2, "none", "R9A"), (3, "x", "plain")], "query_id long, text string, q string")
    assert sorted((r.query_id, r.text) for r in search.with_codes(rows).collect()) == [(1, "see R705 now"), (2, "none"), (3, "x")]


def test_answers(spark):
    text = "As [1] and [2, 3] say, [99] [0] [ 3 ]."
    assert one(spark, A.citations("t", F.lit(5)), t=text) == [1, 2, 3] and one(spark, A.citations("t", F.lit(0)), t=text) == []
    assert one(spark, A.need_probe("t"), t=" need: permits ") == "permits" and one(spark, A.need_probe("t"), t="I NEED: x") is None
    gate = lambda t, s="ok": one(spark, A.refusal(F.lit(s), "t", A.citations("t", F.lit(3)), "I can't tell."), t=t)
    assert (gate("Yes [1]."), gate("Yes [7]."), gate("I can’t tell. [1]"), gate("x", "no_results")) == (None, "no_citations", "model_refused", "no_results")
    long = "word " * 400 + "permit fee permit " + "word " * 400
    cut = one(spark, A.excerpt("t", F.array(F.lit("permit"), F.lit("fee")), F.lit(200)), t=long)
    assert cut.startswith("...") and cut.endswith("...") and "permit fee permit" in cut and len(cut) <= 206
    assert one(spark, A.excerpt("t", F.array(F.lit("zebra")), F.lit(50)), t=long) == ("word " * 10)[:47].rstrip() + "..."
    block = spark.createDataFrame([(["A", "B"], ["x  y", "z"], ["q"])], "l array<string>, t array<string>, q array<string>").select(A.context_block("l", "t", "q").alias("x")).first().x
    assert block == '[1] A\n"x y"\n\n[2] B\n"z"'
    labels = spark.createDataFrame([(["a/Code.pdf", "Code.PDF", None, " b.html "],)], "s array<string>").select(A.consult_labels(F.col("s")).alias("x")).first().x
    assert labels == ["Code", "b"]
    assert one(spark, F.to_json(A.loads_json("t")), t='```json\n{"a": 1}\n```') == '{"a":1}' and one(spark, F.to_json(A.loads_json("t")), t='so {"b":[2]} it is') == '{"b":[2]}'


def test_evaluation_alternatives(spark):
    cases = spark.createDataFrame([(1, ["R1|R2"]), (2, ["zz"]), (3, [])], "query_id long, expect array<string>")
    results = spark.createDataFrame([(1, 1, "none"), (1, 2, "R2 here"), (2, 1, "y")], "query_id long, rank int, text string")
    for c in ("section_number", "section_title", "breadcrumb", "source_file"):
        results = results.withColumn(c, F.lit(None).cast("string"))
    rank = lambda alt: {r.query_id: r.hit_rank for r in evaluate.first_hits(cases, results, alt).collect()}
    assert rank(False) == {1: 0, 2: 0, 3: 0} and rank(True) == {1: 2, 2: 0, 3: 0}
    assert evaluate.summary(evaluate.first_hits(cases, results, True)).first().mrr == pytest.approx(1 / 6, abs=1e-6)


def test_store_builds_purges_and_keeps_old_state(spark, tmp_path):
    store = index_store.IndexStore(spark, str(tmp_path / "index"))
    assert not store.exists() and store.corpora() == []
    schema = "corpus string, path string, sha256 string"
    old, other = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2")], schema), spark.createDataFrame([("d", "a", "3")], schema)
    store.commit("c", {"files": old})
    store.commit("d", {"files": other})
    now = spark.createDataFrame([("c", "a", "1"), ("c", "b", "X"), ("c", "n", "4")], schema)
    change = index_store.changes(now, store.read("files"))
    assert {(r.corpus, r.path): r.action for r in change.collect()} == {("c", "a"): "same", ("c", "b"): "changed", ("c", "n"): "new", ("d", "a"): "gone"}
    touched = change.filter("action <> 'same' and corpus = 'c'")
    store.commit("c", {"files": index_store.replaced(store.read("files", "c"), now.join(touched, ["corpus", "path"], "left_semi"), touched)})
    assert index_store.changes(now, store.read("files", "c")).filter("action <> 'same'").count() == 0
    store.purge(now.filter("path <> 'n'"))
    assert [(r.corpus, r.path) for r in store.read("files").orderBy("corpus").collect()] == [("c", "n"), ("d", "a")] and not store.schema_outdated("c")
    store.purge(now)  # the last row of the corpus
    assert store.read("files", "c").count() == 0 and store.read("files", "c").columns == ["corpus", "path", "sha256"] and store.read("files").count() == 1
    assert sorted(p.name for p in (tmp_path / "index/files/corpus=c").iterdir()) == ["v3", "v4"]
    with pytest.raises(FileNotFoundError):
        store.read("chunks")
    with pytest.raises(ValueError):
        index_store.check_corpus("../etc")
    chunks = lambda *rows: spark.createDataFrame(list(rows), "text string, embedding array<float>")
    index_store.check_chunks(chunks(("a", [1.0]), ("b", [2.0])))
    for bad in (("", [1.0]), ("b", None), ("b", [1.0, 2.0])):
        with pytest.raises(ValueError):
            index_store.check_chunks(chunks(("a", [1.0]), bad))
    rows = spark.createDataFrame([("c", "p", "s", 0, "x"), ("c", "p", "s", 0, "y"), ("c", "p", "s", 1, "x")], "corpus string, path string, section_id string, piece_no int, text string")
    assert sorted((r.piece_no, r.text) for r in index_store.one_each(rows, "chunks").collect()) == [(0, "y"), (1, "x")]


def test_files_of_a_folder(spark, tmp_path):
    for name, data in {"a/x.txt": "caf\xe9".encode("latin-1"), "a/y.md": "é “q”".encode(), "_skip.json": b"{}", ".hid/z.txt": b"z", "b.exe": b"MZ", "c.doc": b"\x00" + b"plain words of an old document" + b"\x01"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.corpus_files(spark, str(tmp_path), "c")
    assert sorted(r.path for r in found.collect()) == ["a/x.txt", "a/y.md", "b.exe", "c.doc"]
    assert [(r.path, r.reason) for r in files.skipped(found).collect()] == [("b.exe", "excluded_by_ext")]
    (tmp_path / "d.PDF").write_bytes(b"%PDF- one\fpage")
    (tmp_path / "e.docx").write_bytes(_docx())
    rows = {r.path: r for r in files.read_files(spark, str(tmp_path), "c").collect()}
    assert rows["a/x.txt"].text == "caf\xe9" and rows["a/y.md"].text == "é “q”" and "plain words" in rows["c.doc"].text
    assert rows["e.docx"].text.startswith("## Top") and (rows["d.PDF"].reason, rows["d.PDF"].pages) == ("no_reader", None) and rows["b.exe"].reason == "excluded_by_ext"
    rows = {r.path: r for r in files.read_files(spark, str(tmp_path), "c", lambda c: c.decode().split("\f")).collect()}
    assert len(rows) == 6 and rows["d.PDF"].pages == ["%PDF- one", "page"] and rows["d.PDF"].reason is None
    log = spark.createDataFrame([("good", "c"), ("clear", "c")], "rating string, corpus string")
    files.append_log(log, str(tmp_path / "log"))
    assert files.feedback_log(spark, str(tmp_path / "log")).count() == 2
    for bad in (("fine", "c"), ("good", "../c"), (None, "c")):
        with pytest.raises(ValueError):
            files.append_log(spark.createDataFrame([bad], "rating string, corpus string"), str(tmp_path / "log"))
    golden = tmp_path / "g.jsonl"
    golden.write_text('{"q": "a", "expect": ["x"]}\n\n{"q": "b"}\n')
    assert files.golden_set(spark, str(golden)).count() == 2


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    par = lambda t, s="": f'<w:p><w:pPr>{f"<w:pStyle w:val={chr(34)}{s}{chr(34)}/>" if s else ""}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{par('a')}</w:tc><w:tc>{par('b')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{par('Top', 'Heading2')}{table}{par('item', 'ListBullet')}{par('text')}</w:body></w:document>")
    return out.getvalue()


def test_docx_text():
    assert files.docx_text(_docx()) == "## Top\n- item\ntext\n| a | b |" and files.docx_text(b"no zip") == ""


def test_layout_sections(spark):
    items = [("text", "before", 1, None), ("title", "Code", 1, None), ("section_header", "101 Scope", 1, 1), ("text", "a", 1, None), ("table", "| x |", 2, None),
             ("section_header", "101.1 More", 2, 2), ("section_header", "102 Next", 2, 1), ("text", None, 2, None), ("text", "b", 3, None)]
    df = spark.createDataFrame([("c", "f", k, *x) for k, x in enumerate(items)], "corpus string, path string, seq int, label string, text string, page int, level int")
    got = [(r.section_id, r.section_number, r.section_title, r.parent_section_id, r.own_text, r.has_table, r.page) for r in chunking.layout_sections(df).orderBy("ord").collect()]
    assert got == [
        ("sec0001", None, "Code", None, "", False, 1), ("sec0002", "101", "Scope", "sec0001", "a\n| x |", True, 1),
        ("sec0003", "101.1", "More", "sec0002", "", False, 2), ("sec0004", "102", "Next", "sec0001", "b", False, 2),
    ]


def test_fields_of_crawled_pages(spark):
    page = '<h1>A <b>guide</b></h1><div class="field--name-document-entity-pub-date x"><div class="field--item">First Published <i>May 1, 2020</i></div></div>'
    assert tuple(one(spark, html.landing_fields("t"), t=page)) == ("A guide", "May 1, 2020", "")
    said = "Code: 2012 Residential Code  Date: March 3, 2014 Section: R101.2.2 x"
    assert tuple(one(spark, html.interpretation_fields("t"), t=said)) == ("2012", "Residential Code", "R101.2.2", "March 3, 2014")
    assert tuple(one(spark, html.interpretation_fields("t"), t="none")) == (None, None, None, None)
    for title, text, want in (("2018 NCRC R305.1 Height", "", "R305.1"), ("x", "see E3601.1", "E3601.1"), ("of 160D-1110", "", "160D-1110"), ("x", "y" * 400 + " R1.1", "")):
        assert one(spark, html.likely_section("a", "b"), a=title, b=text) == want
    links = lambda *xs: "".join(f'<a href="{x}">' for x in xs)
    pages = spark.createDataFrame([(0, links("a", "b", "a")), (1, links("b", "c")), (2, links("a")), (3, links("z"))], "page_no int, html string")
    assert sorted((r.url, r.page_no) for r in html.new_links(pages).collect()) == [("a", 0), ("b", 0), ("c", 1)]
    long = "words of the page " * 20
    main = lambda t: one(spark, html.main_content("t"), t=t)
    assert main(f"<body><nav>menu</nav><main>short</main><div id=displayBody><p>{long}</p></div></body>") == long.strip()
    assert main(f"<body><nav>menu</nav><div class='x pageContent'>{long}<script>s</script></div>tail") == long.strip()
    assert main("<body><header>h</header><p>a</p><p>b<br>c</p></body>") == "a\nb\nc" and main(None) == ""


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"A": "file", "B": "", "C": 3}')
    s = Settings(str(path), {"A": "", "D": "env", "C": "env"})
    assert [s.get(k, "x") for k in "ABCDE"] == ["file", "x", "env", "env", "x"] and Settings(str(tmp_path / "none"), {}).get("A") is None



def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "good") for h in (1, 2, 4) for m in (0, 10, 50)]
    spark.createDataFrame(rows, "t string, rating string").selectExpr("cast(t as timestamp) ts", "rating").write.parquet(str(tmp_path / "s"))
    stream = lambda: spark.readStream.schema("ts timestamp, rating string").parquet(str(tmp_path / "s"))
    got = logs.drained(logs.windowed(stream(), "ts", "rating", "1 hour", "10 minutes"))
    assert sorted(r.n for r in got.collect()) == [3, 3]  # the watermark is 04:40: windows that end later are open
    assert sorted(r.n for r in logs.drained(logs.windowed(stream(), "ts", "rating", "2 hours", "10 minutes", "1 hour")).collect()) == [3, 3, 6]
    assert sorted(r.n for r in logs.drained(logs.sessions(stream(), "ts", "rating", "45 minutes", "10 minutes")).collect()) == [6]


def test_feedback_and_batches(spark, tmp_path):
    one_row = spark.createDataFrame([("c", "q", 3, "good")], "corpus string, query string, rank int, rating string")
    for _ in range(2):
        files.append_log(one_row, str(tmp_path / "log"))
    assert files.feedback_log(spark, str(tmp_path / "log")).filter("rating = 'good' and chunk_id is null").count() == 2
    df = spark.createDataFrame([(k, i, "x" * n) for k in (1, 2, 3) for i, n in enumerate((5, 5, 5, 30, 1))], "k int, i int, t string").repartition(3)
    got = chunking.greedy_batches(df, "t", "k", "i", 2, 12).collect()
    assert sorted((r.k, r.i, r.batch_no) for r in got) == [(k, i, b) for k in (1, 2, 3) for i, b in enumerate([0, 0, 1, 2, 3])]


@settings(max_examples=200, deadline=None)
@given(st.text("ab cd", max_size=200), st.lists(st.sampled_from(["a", "ab", "cd", "d c"]), max_size=3), st.integers(10, 60))
def test_excerpt_is_the_window_with_most_terms(text, terms, budget):
    got, flat = A._window(text, terms, budget), " ".join(text.split())
    hits = [i for t in terms for i in range(len(flat)) if re.compile(re.escape(t)).match(flat, i)]
    plain = [i for t in terms for i in (m.start() for m in re.finditer(re.escape(t), flat))]
    assert set(plain) <= set(hits)
    if len(flat) <= budget:
        assert got == flat
    elif not plain:
        assert got == flat[: budget - 3].rstrip() + "..."
    else:
        starts = [max(0, min(h - budget // 5, len(flat) - budget)) for h in sorted(plain)]
        count = lambda s: sum(s <= h < s + budget for h in plain)
        best = next(s for s in starts if count(s) == max(map(count, starts)))
        assert got.strip(".") == flat[best : best + budget].strip() and got.startswith("...") == (best > 0)


@settings(max_examples=100, deadline=None)
@given(st.text("ab .\n!", max_size=400), st.integers(210, 300))
def test_windows_end_at_the_last_boundary(text, size):
    """By looking at every place that a window may end at."""
    at, want = 0, []
    while at < len(text) and len(text) > size:
        stop = min(at + size, len(text))
        if stop < len(text):
            ends = range(stop, max(at, stop - chunking.BACK), -1)
            rank = lambda e: 0 if text[at:e].endswith("\n\n") and e - 2 >= stop - chunking.BACK else 1 if text[e - 2 : e] in chunking.SENTENCE_ENDS and e - 2 >= stop - chunking.BACK else 2 if text[e - 1] == " " else 3
            best = min(map(rank, ends))
            stop = stop if best == 3 else next(e for e in ends if rank(e) == best)
        if text[at:stop].strip():
            want.append((at, stop, text[at:stop].strip()))
        if stop >= len(text):
            break
        at = stop - size // 8 if stop - size // 8 > at else stop
    got = chunking.windows(text, size, size // 8)
    assert got == (want if len(text) > size else [(0, len(text), text)] if text else [])


def test_delta_of_references_equals_full_resolution(spark):
    """Files that come, change and go, in any mixture: the same as resolving all, and only what is affected meets sections."""
    rng = random.Random(7)
    schema = "corpus string, path string, section_id string, section_number string, own_text string, full_text string"
    numbers, statutes = ["R1.1", "1.1", "1.2", "RR1.2", "2.1", None], ["160D-1110", "160D-11", "143-138"]

    def file_of(path):
        rows = []
        for k in range(rng.randint(0, 4)):
            text = " ".join(f"Section {rng.choice(['R1.1', '1.1', '1.2', 'R2.1', '9.9'])}, N.C.G.S. {rng.choice(statutes)}" for _ in range(rng.randint(0, 2)))
            rows.append(("c", path, f"s{k}", rng.choice(numbers), text, text + " more" * rng.randint(0, 2)))
        return rows

    state = {f"f{k}": file_of(f"f{k}") for k in range(6)}
    frame = lambda s: spark.createDataFrame([r for rows in s.values() for r in rows], schema)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*graph.REF, "dst_path", "dst_section_id").collect())
    keys = graph.listed_keys(frame(state))
    done = graph.resolve_by(graph.extract_refs(frame(state)), keys)
    for change in (["f0"], ["f1", "f6"], ["f2", "f3", "f7"], []):
        for path in change:
            state[path] = file_of(path) if rng.random() < 0.7 else []
        touched = spark.createDataFrame([("c", p) for p in change], "corpus string, path string")
        refs, now = graph.extract_refs(frame(state)), graph.listed_keys(frame(state))
        done, keys = written(graph.propagate(done, refs, keys, now, touched), "done"), now
        assert rows(done) == rows(graph.resolve_refs(refs, frame(state)))
    other = {**state, "f0": [("c", "f0", "s0", "7.7", "", "")]}
    none = graph.changed_keys(graph.listed_keys(frame(state)), graph.listed_keys(frame(state)), spark.createDataFrame([("c", "f0")], "corpus string, path string"))
    assert none.count() == 0  # touched, and nothing listed otherwise
    only = graph.changed_keys(graph.listed_keys(frame(state | {"f0": []})), graph.listed_keys(frame(other)), spark.createDataFrame([("c", "f0")], "corpus string, path string"))
    assert [tuple(r) for r in only.collect()] == [("c", "internal_section", "7.7")]
    touched = spark.createDataFrame([("c", "f0")], "corpus string, path string")
    assert graph.affected_refs(graph.extract_refs(frame(other)), only, touched).count() == 0


def test_delta_reads_sections_of_touched_files_only(spark, monkeypatch):
    from spindrift.plans import index_queries

    read = {}
    for name in ("extract_refs", "listed_keys"):
        own = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda s, own=own, name=name: read.setdefault(name, []).append({r.path for r in s.select("path").distinct().collect()}) or own(s))
    assert index_queries.delta_resolved(spark, "/root/testdata/sf0.001").count() > 0
    for before, after in read.values():
        assert len(before) == 5 and after == {"region-0", "region-1"}


def test_references_meet_sections_without_a_join_of_their_own(spark):
    s = spark.createDataFrame([("c", "f", "a", "1.2", ""), ("c", "f", "b", "R7.1", "160D-1110")], "corpus string, path string, section_id string, section_number string, full_text string")
    r = [("c", "f", "b", "1.2", "internal_section"), ("c", "f", "a", "160D-1110", "ncgs"), ("c", "f", "a", "9.9", "internal_section"), ("c", "f", "a", "160D-1110", "other"), ("c", "f", "a", "7.1", None)]
    refs = spark.createDataFrame(r, "corpus string, path string, src_section_id string, dst_raw string, dst_kind string")
    done = graph.resolve_refs(refs, s)
    assert not re.search(r"hashpartitioning\([^)]*src_section_id", done._jdf.queryExecution().toString())
    assert sorted((x.dst_raw, str(x.dst_kind), str(x.dst_path), str(x.dst_section_id)) for x in done.collect()) == [
        ("1.2", "internal_section", "f", "a"), ("160D-1110", "ncgs", "f", "b"), ("160D-1110", "other", "None", "None"), ("7.1", "None", "None", "None"), ("9.9", "internal_section", "None", "None")
    ]


def test_references_are_read_by_as_many_tasks_as_sections_need(spark, monkeypatch):
    monkeypatch.setattr(graph, "SECTIONS", 10, raising=False)
    rows = [("c", f"f{k % 5}", f"s{k % 50}", "See Section 1.2, § 1.2") for k in range(100)]
    one = spark.createDataFrame(rows, "corpus string, path string, section_id string, own_text string").coalesce(1)
    refs = graph.extract_refs(one)
    assert refs.count() == 50 and {r.dst_raw for r in refs.collect()} == {"1.2"}
    assert refs.select(F.spark_partition_id()).distinct().count() > 5
