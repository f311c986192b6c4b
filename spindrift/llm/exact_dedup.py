"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

Texts are equal when they are identical after deleting ASCII white space. Every
normalised text is cut where its content says so; each distinct chunk crosses the
network once, to verify that its 64-bit hash names no other chunk, and from then on
a document is the ordered list of its chunks' identifiers. Documents are grouped by
that list, which is some hundred times shorter than the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spindrift.session import written

#: A chunk ends at the first punctuation mark after MIN_CHUNK characters, or at MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 256, 2048
_ENDS = ".!?;:,"


def normalised(text: Column) -> Column:
    """The text (null: empty) without white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def chunks_of(norm: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The chunks in order; joined they are ``norm`` again. Empty text: no chunks."""
    pattern = rf"(?s).{{{shortest},{longest - 1}}}?[{_ENDS}]|.{{1,{longest}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _hash(chunk: Column, bits: int) -> Column:
    full = F.xxhash64(chunk)
    return full if bits >= 64 else full.bitwiseAND(F.lit((1 << bits) - 1))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_bits: int = 64,
    shortest: int = MIN_CHUNK,
    longest: int = MAX_CHUNK,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points in its original text stays, then
    the one with the smallest id (null ids last), then one of the rows that agree in
    both. Null text counts as empty; all empty texts form one group. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    ``hash_bits`` below 64 makes chunk hashes collide, for tests of the verification.
    """
    base = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    norm = normalised(F.col("text"))

    # Verify: a hash that stands for two chunks is ambiguous, and is told apart by rank.
    distinct = (
        base.select(F.explode(chunks_of(norm, shortest, longest)).alias("chunk"))
        .select(_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
        .groupBy("h", "chunk")
        .agg(F.lit(1).alias("one"))
    )
    ambiguous = distinct.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    ambiguous = written(ambiguous, "op7-ambiguous")
    clash = not ambiguous.isEmpty()
    if clash:
        base = written(base, "op7-rows")  # two readers below need the same row ids

    recipe = F.transform(chunks_of(norm, shortest, longest), lambda c: _hash(c, hash_bits))
    slim = base.select(
        "row_id",
        "doc_id",
        F.length("text").alias("n_chars"),
        F.sha2(norm, 256).alias("text_sha256"),
        recipe.alias("recipe"),
        F.lit(None).cast("array<long>").alias("ranks"),
    )
    if clash:
        slim = _with_ranks(base, slim, ambiguous, hash_bits, shortest, longest)
    slim = written(slim, "op7-recipes")

    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), "doc_id", "row_id"))
    groups = written(
        slim.groupBy("recipe", "ranks").agg(F.count("*").alias("group_size"), best.alias("best")), "op7-groups"
    )
    g = groups.select(
        F.col("recipe").alias("g_recipe"), F.col("ranks").alias("g_ranks"), "group_size",
        F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"),
    )
    same = (F.col("recipe") == F.col("g_recipe")) & F.col("ranks").eqNullSafe(F.col("g_ranks"))
    return slim.join(g, same).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def _with_ranks(base, slim, ambiguous, hash_bits, shortest, longest):
    """Add to each recipe the ranks of its ambiguous chunks among those that share their hash, in order.

    Only rows that hold such a chunk move, keyed by hash and chunk; with 64 bits there are hardly any.
    """
    norm = normalised(F.col("text"))
    pieces = (
        base.select(
            F.col("row_id").alias("p_row"),
            F.posexplode(chunks_of(norm, shortest, longest)).alias("pos", "chunk"),
        )
        .withColumn("h", _hash(F.col("chunk"), hash_bits))
        .join(ambiguous, "h", "left_semi")
    )
    pieces = written(pieces, "op7-pieces")
    names = pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    rivals = names.groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("rivals"))  # chunks of one 64-bit hash
    ranked = written(
        rivals.select("h", F.posexplode("rivals").alias("rank", "chunk")), "op7-ranks"
    )
    by_row = (
        pieces.join(ranked, ["h", "chunk"])
        .groupBy("p_row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("r"))
        .select("p_row", F.transform("r", lambda x: x["rank"].cast("long")).alias("found"))
    )
    return slim.join(by_row, slim["row_id"] == by_row["p_row"], "left").select(
        "row_id", "doc_id", "n_chars", "text_sha256", "recipe", F.col("found").alias("ranks")
    )
