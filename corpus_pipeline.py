"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, whatever
their texts; all but the last return the columns of ``docs``, further ones included, whatever their names. Empty tables
give no rows; repeated rows are rows of their own, but copies for the near-dedup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindrift.llm import decontaminate, language_id, mixing, near_copies, rows, token_files
from spindrift.session import table, written

#: A document stays if its best language's mean probability is by this share of the way from pure chance (1 / languages) to certainty.
LANGUAGE_MARGIN = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go (null texts too), and those whose best language is hardly likelier than the others.

    Rows without a language or an id are judged, not learned from. Where no language could be learned, all documents pass.
    """
    field = language_id.fit(docs)
    if not field.languages:
        return docs
    lang, score = rows.unused(docs.columns, "lang_pred", "score")
    found = language_id.identify(docs, field, names=(lang, score))
    chance = 1 / len(field.languages)
    least = chance + LANGUAGE_MARGIN * (1 - chance) if chance < 1 else 0.0
    stays = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= least)
    return found.filter(stays).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: that of the smallest id, null last.

    Of equal ids the first row in the files stays. Texts without words, null ones too, are one group.
    """
    return near_copies.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go.

    Null and empty texts stay as they are; null and empty items match nothing.
    """
    columns = docs.columns
    clean = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it. Null is a source of its own; ties of the keys are broken by text and place."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard files, read back: ``doc_id, start, n_tokens, ids_crc32``, in the order of ids (null first) and texts."""
    return token_files.encoded(docs, with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("mixing sources", mix_sources),
    ("token files", write_token_files),
]

#: Language ID, the sampling keys and the tokenizer have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
