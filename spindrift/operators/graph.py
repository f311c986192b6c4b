"""The section tree and the citation graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spindrift.functions.text import text_of
from spindrift.session import written

# References to a section or table, and to a statute.
INTERNAL = (
    r"(?:Section|Sec\.|§)\s*([A-Z]?\d+(?:\.\d+)+|\bR\d{3,4}(?:\.\d+)*)"
    r"|\b(R\d{3,4}(?:\.\d+)+)\b"
    r"|\bTable\s+([A-Z]?\d+(?:\.\d+)+)\b"
)
_BEFORE_NUMBER = r"^(?:(?:Section|Sec\.|§)\s*|Table\s+)"
_STATUTE_FORM = r"\d{2,3}[A-Z]?-\d+(?:\.\d+)?"
STATUTE = r"(?:N\.?C\.?G\.?S\.?\s*)?\b(\d{2,3}[A-Z]?-\d+(?:\.\d+)?)(?:\([a-z0-9]+\))*\b"
#: Sections that expansion adds to a query's results, and the score they get.
EXPANSION, REFERENCE_SCORE = 3, -1.0
#: Sections that a task reads for references, about.
SECTIONS = 65_536
#: Levels that a tree may have.
DEPTH = 32


def internal_refs(text: Column | str) -> Column:
    """Distinct section numbers referred to: what matches, without the word before the number."""
    found = F.regexp_extract_all(text_of(text), F.lit(INTERNAL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, _BEFORE_NUMBER, "")))


def statute_refs(text: Column | str) -> Column:
    """Distinct statutes referred to: those with a capital letter."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text_of(text), F.lit(STATUTE), F.lit(1)), lambda x: x.rlike("[A-Z]")))


def spread(sections: DataFrame) -> DataFrame:
    """``sections`` dealt to tasks by section: as many tasks as shuffles have, and more where each would get more than SECTIONS.

    A scan cuts files by their bytes, so millions of short sections may come in one task; reading them for references takes far longer than moving them.
    """
    n = max(int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sections.count() // SECTIONS))
    return sections.repartition(n, "corpus", "path", "section_id")


def extract_refs(sections: DataFrame, text_col: str = "own_text") -> DataFrame:
    """``corpus, path, src_section_id, dst_raw, dst_kind``, one row per section, kind and number. All rows of a section are made, and told apart, in one task."""
    kinds = F.array(
        F.struct(F.lit("internal_section").alias("k"), internal_refs(text_col).alias("raw")),
        F.struct(F.lit("ncgs").alias("k"), statute_refs(text_col).alias("raw")),
    )
    rows = spread(sections.select("corpus", "path", "section_id", text_col)).select("corpus", "path", F.col("section_id").alias("src_section_id"), F.explode(kinds).alias("x"))
    return rows.select("corpus", "path", "src_section_id", F.explode("x.raw").alias("dst_raw"), F.col("x.k").alias("dst_kind")).distinct()


def said_statutes(text: Column | str) -> Column:
    """Everything that has the form of a statute and occurs in the text, in whatever case, as a part of a longer number too.

    A lookahead finds one at every place that one may start, and each of its beginnings that has the form is one too.
    """
    ends = lambda m: F.sequence(F.instr(m, "-") + 1, F.length(m))
    found = F.array_distinct(F.regexp_extract_all(F.upper(text_of(text)), F.lit(rf"(?=({_STATUTE_FORM}))"), F.lit(1)))
    parts = F.flatten(F.transform(found, lambda m: F.transform(ends(m), lambda n: F.left(m, n))))
    return F.array_distinct(F.filter(parts, lambda p: ~p.endswith(".")))


def first_two(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys`` and ``two``: the two smallest different values of the struct ``x`` of each key, in order.

    Two are enough for a reference, which excludes one at most, the section it stands in.
    Each task passes on two values of a key, so that a hot key is no hot task.
    """
    nth = F.dense_rank().over(W.partitionBy(*keys).orderBy("x"))
    least = rows.select(*keys, "x", nth.alias("nth")).filter("nth <= 2")
    return written(least.groupBy(*keys).agg(F.array_sort(F.collect_set("x")).alias("two")), name)


REF = ["corpus", "path", "src_section_id", "dst_raw", "dst_kind"]


def listed_keys(sections: DataFrame) -> DataFrame:
    """``corpus, path, section_id, kind, key, less``: what a reference may find each section by.

    A section is listed under its number and under the number without its leading capitals, and
    under every statute that its text contains. ``less`` orders sections of one statute: longest first.
    """
    bare = F.array_distinct(F.array("section_number", F.regexp_replace("section_number", "^[A-Z]+", "")))
    kinds = F.array(
        F.struct(F.lit("internal_section").alias("kind"), F.when(F.col("section_number").isNotNull(), bare).alias("keys"), F.lit(0).alias("less")),
        F.struct(F.lit("ncgs").alias("kind"), said_statutes("full_text").alias("keys"), (-F.length("full_text")).alias("less")),
    )
    rows = spread(sections.select("corpus", "path", "section_id", "section_number", "full_text")).select("corpus", "path", "section_id", F.explode(kinds).alias("x"))
    return rows.select("corpus", "path", "section_id", "x.kind", F.explode("x.keys").alias("key"), "x.less")


def asked_keys(refs: DataFrame) -> DataFrame:
    """``refs`` once for each key (``kind, key``) on which their resolution depends: a number also without its leading R."""
    keys = F.when(F.col("dst_kind") == "internal_section", F.array_distinct(F.array("dst_raw", _bare("dst_raw")))).otherwise(F.array("dst_raw"))
    return refs.select(*REF, F.col("dst_kind").alias("kind"), F.explode(keys).alias("key"))


def resolve_refs(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """``refs`` with ``dst_section_id`` (and ``dst_path``), null where nothing fits: see :func:`resolve_by`."""
    return resolve_by(refs, written(listed_keys(sections), "listed"))


def resolve_by(refs: DataFrame, listed: DataFrame) -> DataFrame:
    """``refs`` with ``dst_section_id`` (and ``dst_path``) by what sections are listed under, null where nothing fits.

    A section number goes to what is listed under it, and only if nothing is, to what is listed
    under it without its leading R; the same file is preferred, then file and section order;
    never to the section itself. A statute goes to the longest other section whose text
    contains it, in whatever case. Sections are reduced to two for each number and for each statute
    before they meet the references.
    """
    s = listed.select("corpus", F.col("path").alias("s_path"), F.col("section_id").alias("s_id"), "kind", "key", "less")
    numbers = s.filter("kind = 'internal_section'").select("corpus", "s_path", F.col("key").alias("number"), F.struct("s_path", "s_id").alias("x"))
    anywhere = first_two(numbers, ["corpus", "number"], "numbers-two")
    in_file = first_two(numbers, ["corpus", "number", "s_path"], "file-numbers-two")

    out = [*refs.columns, F.col("to.s_path").alias("dst_path"), F.col("to.s_id").alias("dst_section_id")]
    wanted = refs.filter("dst_kind = 'internal_section'")
    as_is, without = (anywhere.select("corpus", F.col("number").alias(n), F.col("two").alias(t)) for n, t in (("dst_raw", "t0"), ("bare", "t1")))
    wanted = wanted.withColumn("bare", _bare("dst_raw")).join(as_is, ["corpus", "dst_raw"], "left").join(without, ["corpus", "bare"], "left")
    # a number that is listed nowhere is in no file: those who ask for it are dealt by their own sections, as it may be asked for often
    number = F.when(F.col("t0").isNotNull(), F.col("dst_raw")).when(F.col("t1").isNotNull(), F.col("bare")).otherwise(F.concat(F.lit(" "), "src_section_id"))
    wanted = wanted.withColumn("number", number).withColumn("any", F.coalesce("t0", "t1"))
    own = in_file.select("corpus", "number", F.col("s_path").alias("path"), "two")
    wanted = wanted.join(own, ["corpus", "number", "path"], "left")
    other = lambda c: F.filter(c, lambda v: (v["s_id"] != F.col("src_section_id")) | (v["s_path"] != F.col("path")))
    best = F.coalesce(F.get(other(F.col("two")), F.lit(0)), F.get(other(F.col("any")), F.lit(0)))
    by_number = wanted.withColumn("to", best).select(*out)

    statutes = refs.filter("dst_kind is distinct from 'internal_section'")  # of other kinds nothing fits
    said = s.filter("kind = 'ncgs'").select("corpus", F.struct("less", "s_path", "s_id").alias("x"), F.col("key").alias("dst_raw"))
    said = said.join(statutes.select("corpus", "dst_raw").distinct(), ["corpus", "dst_raw"], "left_semi")
    by_statute = statutes.join(first_two(said, ["corpus", "dst_raw"], "statutes-two"), ["corpus", "dst_raw"], "left")
    by_statute = by_statute.withColumn("to", F.when(F.col("dst_kind") == "ncgs", F.get(other(F.col("two")), F.lit(0)))).select(*out)
    return by_number.unionByName(by_statute)


def _bare(number: Column | str) -> Column:
    return F.regexp_replace(number, "^R+", "")


def changed_keys(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """``corpus, kind, key`` under which something else is listed than before. Only what ``touched`` files list is read.

    Entries count 1 after and -1 before; those that cancel out have not changed. They are summed before the shuffle.
    """
    signed = lambda rows, n: rows.join(touched, ["corpus", "path"], "left_semi").withColumn("n", F.lit(n))
    entries = signed(after, 1).unionByName(signed(before, -1))
    return entries.groupBy("corpus", "path", "section_id", "kind", "key", "less").agg(F.sum("n").alias("n")).filter("n <> 0").select("corpus", "kind", "key").distinct()


def marked(refs: DataFrame, changed: DataFrame) -> DataFrame:
    """``refs`` with ``anew``: whether what they ask for may have ``changed``. A number and the same with an R before it are taken for one here, so that a reference asks for one key."""
    key = lambda kind, c: F.when(F.col(kind) == "internal_section", _bare(c)).otherwise(F.col(c)).alias("key")
    keys = changed.select("corpus", F.col("kind").alias("dst_kind"), key("kind", "key")).distinct().withColumn("anew", F.lit(True))
    rows = refs.select("*", key("dst_kind", "dst_raw")).join(keys, ["corpus", "dst_kind", "key"], "left")
    return rows.select(*refs.columns, F.coalesce("anew", F.lit(False)).alias("anew"))


def affected_refs(refs: DataFrame, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """The references that may resolve otherwise than before: those of ``touched`` files, and those that ask for a changed key."""
    others = marked(refs.select(*REF).join(touched, ["corpus", "path"], "left_anti"), changed)
    return others.filter("anew").select(*REF).unionByName(refs.select(*REF).join(touched, ["corpus", "path"], "left_semi"))


def propagate(resolved: DataFrame, refs: DataFrame, before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """What ``resolve_by(refs, after)`` gives, from what was ``resolved`` by ``before``.

    ``touched`` are the files (``corpus, path``) of which sections, or references, were added, changed or
    removed; the references of all others are those that were resolved. Only affected references meet sections, and only sections that one of them asks for; all
    others keep what they had. Nothing but the keys of sections is read, never their texts.
    """
    touched = written(touched.select("corpus", "path").distinct(), "touched")
    out = [*REF, "dst_path", "dst_section_id"]
    others = resolved.select(*out).join(touched, ["corpus", "path"], "left_anti")
    others = written(marked(others, written(changed_keys(before, after, touched), "changed-keys")), "marked")
    affected = written(others.filter("anew").select(*REF).unionByName(refs.select(*REF).join(touched, ["corpus", "path"], "left_semi")), "affected")
    wanted = asked_keys(affected).select("corpus", "kind", "key").distinct()
    anew = resolve_by(affected, written(after.join(wanted, ["corpus", "kind", "key"], "left_semi"), "wanted"))
    return others.filter("not anew").select(*out).unionByName(anew.select(*out))


def trails(sections: DataFrame, key: str = "section_id", parent: str = "parent_section_id", depth: int = DEPTH) -> DataFrame:
    """``key, trail``: ids and labels from the root down to the section. Cycles end where they close, parents that do not exist at once.

    Pointers double: each round joins every node to twice as many of its ancestors, so that
    the number of joins is the logarithm of ``depth``.
    """
    label = F.nullif(F.concat_ws(" ", F.nullif(text_of("section_number"), F.lit("")), F.nullif(text_of("section_title"), F.lit(""))), F.lit(""))
    known = sections.select(F.col(key).alias("p_key"))
    rows = sections.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.array(F.struct(F.col(key).alias("id"), label.alias("label"))).alias("trail"))
    rows = rows.join(known, rows["up"] == known["p_key"], "left").select("k", F.col("p_key").alias("up"), "trail")
    for round_ in range(max(1, (depth - 1).bit_length())):
        above = rows.select(F.col("k").alias("a_k"), F.col("up").alias("a_up"), F.col("trail").alias("a_trail"))
        rows = rows.join(above, rows["up"] == above["a_k"], "left").select("k", F.col("a_up").alias("up"), F.concat(F.coalesce("a_trail", F.array().cast(rows.schema["trail"].dataType)), "trail").alias("trail"))
        rows = written(rows, f"crumbs-{round_}")
    # In a cycle the trail repeats: keep the nearest mention of each id.
    clean = F.aggregate(
        F.reverse("trail"),
        F.array().cast(rows.schema["trail"].dataType),
        lambda acc, t: F.when(F.exists(acc, lambda a: a["id"] == t["id"]), acc).otherwise(F.concat(F.array(t), acc)),
    )
    return rows.select(F.col("k").alias(key), clean.alias("trail"))


def breadcrumbs(trail: DataFrame, key: str = "section_id") -> DataFrame:
    """``key, breadcrumb`` of what :func:`trails` gives: labels from the root down, joined by ``>``."""
    labels = F.filter(F.transform("trail", lambda t: t["label"]), lambda x: x.isNotNull())
    return trail.select(key, F.array_join(labels, " > ").alias("breadcrumb"))


def rolled_up(sections: DataFrame, trail: DataFrame) -> DataFrame:
    """``full_text`` of sections with ``section_id, ord, own_text``: their own text and that of all below, in reading order.

    ``trail`` is what :func:`trails` gives. A text goes to each section of its trail, by an equi-join, so work is the size
    of the texts times the depth of the tree.
    """
    texts = sections.select("section_id", "ord", F.col("own_text").alias("t")).filter("t <> ''")
    below = texts.join(trail, "section_id").select(F.explode("trail.id").alias("section_id"), "ord", "t")
    text = below.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), "\n\n").alias("full_text"))
    return sections.join(text, "section_id", "left").withColumn("full_text", text_of("full_text"))


def drop_ancestors(results: DataFrame) -> DataFrame:
    """Without results (``query_id, corpus, path, section_id``) that are the direct parent of another result of the same query."""
    keys = ["query_id", "corpus", "path"]
    parents = results.filter("parent_section_id is not null").select(*keys, F.col("parent_section_id").alias("section_id")).distinct()
    return results.join(parents, [*keys, "section_id"], "left_anti")


def expand_once(results: DataFrame, refs: DataFrame, sections: DataFrame, most: int = EXPANSION) -> DataFrame:
    """Up to ``most`` further sections per query, that the results (``query_id, corpus, path, section_id, rank``) refer to.

    In the order of the results and then of the references; each once; none that the query has.
    Returns ``query_id, corpus, path, section_id, referenced_by, reference_raw, score, ref_rank``.
    """
    r = refs.filter("dst_section_id is not null").select("corpus", "path", F.col("src_section_id").alias("section_id"), "dst_raw", "dst_path", "dst_section_id")
    to = ["corpus", "dst_path", "dst_section_id"]
    have = results.select("query_id", "corpus", F.col("path").alias("dst_path"), F.col("section_id").alias("dst_section_id"))
    hits = results.select("query_id", "corpus", "path", "section_id", "rank").join(r, ["corpus", "path", "section_id"]).join(have, ["query_id", *to], "left_anti")
    there = sections.select("corpus", F.col("path").alias("dst_path"), F.col("section_id").alias("dst_section_id")).distinct()
    hits = hits.join(there, to, "left_semi")
    once = W.partitionBy("query_id", *to).orderBy("rank", "path", "section_id", "dst_raw")
    hits = hits.withColumn("n", F.row_number().over(once)).filter("n = 1")
    order = W.partitionBy("query_id").orderBy("rank", "path", "section_id", "dst_raw", "dst_path", "dst_section_id")
    return hits.withColumn("ref_rank", F.row_number().over(order)).filter(F.col("ref_rank") <= most).select(
        "query_id", "corpus", F.col("dst_path").alias("path"), F.col("dst_section_id").alias("section_id"), F.col("section_id").alias("referenced_by"),
        F.col("dst_raw").alias("reference_raw"), F.lit(REFERENCE_SCORE).alias("score"), "ref_rank",
    )
