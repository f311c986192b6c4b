from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import registry, rows as R

from .conftest import prose


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    item = prose(70, 40)
    texts = [prose(k, 120) for k in range(40)] + [None, "", "12 34", prose(3, 120), f"{prose(41, 80)} {item} {prose(42, 90)}", item]
    rows = [(k, t, "en" if k % 2 else "fr", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, ids = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == schema.replace(",", "").split()[::2]
        ids.append(sorted(r.doc_id for r in docs.collect()))
    assert ids[0] == [*range(40), 43, 44, 45]  # no letters, no language
    assert ids[1] == [*range(40), 44, 45]  # 43 is a copy of 3
    assert ids[2] == [*range(40), 44]  # 45 is nothing but the item
    cut = next(r for r in spark.read.parquet(f"{d}/out2").collect() if r.doc_id == 44)
    assert item not in cut.text and cut.n_chars == len(cut.text)
    assert ids[3] == ids[4] and set(ids[3]) <= set(ids[2])
    assert corpus_pipeline.run(spark, d).count() == len(ids[4])


CLASHING = "lang_pred string, score string, n_words string, hit_spans string, hit_items string, place string, times string, value string, node string, doc string, row string"


def test_stages_bring_all_columns_and_odd_rows_through(spark, tmp_path):
    """Extra columns with names that stages use inside, null ids, texts and languages, repeated rows, very long and empty texts."""
    texts = [prose(k, 60) for k in range(12)] + [prose(99, 20_000), None, "", prose(0, 60)]
    rows = [(k if k % 5 else None, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else "s", len(t or ""), *[f"{c}{k}" for c in range(11)]) for k, t in enumerate(texts)]
    rows += rows[3:5]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    d = str(tmp_path)
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, prose(70, 12)), (None, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, None) for k in range(4)] + [(None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    given, docs = set(rows), spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        assert docs.dtypes == spark.createDataFrame([], schema).dtypes
        kept.append([tuple(r) for r in docs.collect()])
        assert set(kept[-1]) <= given
    assert len(kept[0]) == len(rows) - 2 and len(kept[1]) == len(kept[2]) == 13  # no letters; copies of 0, 3 and 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == len(kept[3])


def test_pipeline_over_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.count() == 0 and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_rows_beside_their_files(spark, frame, tmp_path):
    docs = frame([prose(k, 5) for k in range(40)])
    docs.write.parquet(str(tmp_path / "d"))
    for source in (docs, spark.read.parquet(str(tmp_path / "d"))):
        placed = R.in_files(source, "t")
        named = R.with_place(placed, "p").filter("doc_id % 3 = 0").select(F.col("p").alias("place"), (F.col("doc_id") * 2).alias("value"))
        got = R.beside(placed, named, "v")
        assert got.columns == [*docs.columns, "v"] and sorted((r.doc_id, r.v) for r in got.collect()) == [(k, 2 * k) for k in range(0, 40, 3)]
        assert R.beside(placed, named.limit(0), "v").count() == 0
    doubled = spark.read.parquet(str(tmp_path / "d")).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    assert R.with_place(R.in_files(doubled, "t"), "p").select("p").distinct().count() == 80


def test_language_stage_passes_all_without_languages(frame, tmp_path):
    docs = frame([prose(k, 30) for k in range(6)], langs=[None] * 6).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.identify_language(docs.sparkSession, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 6


def test_registry_names():
    assert sorted(n.split("_")[0] for n in registry.queries()) == sorted(f"op{k}" for k in range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
