"""Readers of a corpus folder: eligible files, skipped files, text, old word files, golden sets and logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spindrift.functions import text as X

# Endings that can be read, and the largest file.
TEXT_ENDINGS = (".txt", ".md", ".markdown", ".rst", ".csv", ".log", ".json", ".xml", ".html", ".htm")
ENDINGS = (*TEXT_ENDINGS, ".pdf", ".docx", ".doc")
MAX_BYTES = 100 * 1024 * 1024
RATINGS, CORPUS_NAME = ("good", "bad", "clear"), r"[a-z0-9][a-z0-9_\-]*"
GOLDEN = "q string, expect array<string>, expect_cite array<string>, expect_answer array<string>, note string"


def _load(spark: SparkSession, folder: str, endings: tuple[str, ...] = ()) -> DataFrame:
    """The files below a folder, or those with one of the endings, in whatever case: only these are opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if endings:
        any_case = lambda e: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e)
        reader = reader.option("pathGlobFilter", "{" + ",".join(f"*{any_case(e)}" for e in endings) + "}")
    return reader.load(folder)


def corpus_files(spark: SparkSession, folder: str, corpus: str) -> DataFrame:
    """``corpus, path, size, modified, basename, ext`` of all files below a folder but hidden and underscored ones."""
    return entries(_load(spark, folder).drop("content"), folder, corpus)


def entries(found: DataFrame, folder: str, corpus: str) -> DataFrame:
    """Rows of the file listing (with ``content``, if they have it) under their paths below the folder."""
    at = F.instr(F.col("path"), folder.rstrip("/") + "/")
    rel = F.when(at > 0, F.substring(F.col("path"), at + len(folder.rstrip("/")) + 1, F.length("path"))).otherwise(F.col("path"))
    content = ["content"] if "content" in found.columns else []
    rows = found.select(F.lit(corpus).alias("corpus"), rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *content)
    rows = rows.withColumn("basename", F.substring_index("path", "/", -1)).withColumn("ext", X.extension("basename"))
    hidden = F.col("basename").rlike("^[._]") | F.col("path").rlike(r"(^|/)\.")
    return rows.filter(~hidden)


def skip_reason(ext: Column | str = "ext", size: Column | str = "size") -> Column:
    """Why a file is not read, or null."""
    ext, size = (F.col(c) if isinstance(c, str) else c for c in (ext, size))
    return F.when(~ext.isin(*ENDINGS), "excluded_by_ext").when(size.isNull(), "read_error").when(size > MAX_BYTES, "file_too_large")


def eligible(files: DataFrame) -> DataFrame:
    return files.filter(skip_reason().isNull())


def skipped(files: DataFrame) -> DataFrame:
    return files.withColumn("reason", skip_reason()).filter("reason is not null")


def listed(spark: SparkSession, folder: str, corpus: str, pdf_reader: bool = False) -> DataFrame:
    """``corpus, path, ext, size, sha256, reason`` of all files of a folder. Files that can be read are hashed in the tasks and not parsed, others are only listed.

    ``reason`` says why a file has no text: its ending, its size, or (``no_reader``) a PDF file without a reader of pages.
    """
    found = entries(_load(spark, folder, ENDINGS).filter(F.col("length") <= MAX_BYTES), folder, corpus)
    no_reader = F.when((F.col("ext") == ".pdf") & F.lit(not pdf_reader), "no_reader")
    found = found.select("corpus", "path", "ext", "size", F.sha2("content", 256).alias("sha256"), no_reader.alias("reason"))
    left = skipped(corpus_files(spark, folder, corpus)).withColumn("sha256", F.lit(None).cast("string"))
    return found.unionByName(left.select(*found.columns))


def read_files(spark: SparkSession, folder: str, corpus: str, pdf_pages: Callable[[bytes], list[str]] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``corpus, path, ext, size, sha256, text, pages, reason`` of all files of a folder, or of ``only`` those (``corpus, path``) that can be read, by type.

    Text, HTML, old and new word files give ``text``, as it is in the file; PDF files give ``pages``, by the provider. ``reason`` says
    why a file has neither. Only the wanted files are decoded, unzipped or given to the provider, each once; files that are not read are only listed.
    """
    found = entries(_load(spark, folder, ENDINGS).filter(F.col("length") <= MAX_BYTES), folder, corpus)
    if only is not None:
        found = found.join(only.select("corpus", "path"), ["corpus", "path"], "left_semi")
    out = parsed(found, pdf_pages)
    if only is not None:
        return out
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in ("sha256", "text", "pages")}
    return out.unionByName(skipped(corpus_files(spark, folder, corpus)).withColumns(none).select(*out.columns))


def parsed(found: DataFrame, pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``corpus, path, ext, size, sha256, text, pages, reason`` of files with their ``content``, by type."""
    found = found.withColumn("sha256", F.sha2("content", 256))
    kind = F.when(F.col("ext") == ".docx", F.lit("word")).when(F.col("ext") == ".pdf", F.lit("paper")).otherwise(F.lit("plain"))
    of = lambda k: F.when(kind == k, F.col("content"))
    plain = F.when(F.col("ext") == ".doc", X.legacy_doc_text(F.col("content"))).otherwise(X.decode_text(F.col("content")))
    found = found.withColumn("text", F.when(kind == "word", docx_column(of("word"))).when(kind == "plain", plain))
    pages = F.lit(None).cast("array<string>") if pdf_pages is None else F.when(kind == "paper", pages_column(pdf_pages)(of("paper")))
    reason = F.when((kind == "paper") & F.lit(pdf_pages is None), "no_reader")
    return found.withColumn("pages", pages).withColumn("reason", reason).select("corpus", "path", "ext", "size", "sha256", "text", "pages", "reason")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Headings with number signs, list items with dashes, then the tables as rows of cells."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = re.match(r"[Hh]eading\s*(\d)", name)
        if line := words(p):
            out.append(("#" * int(level[1]) + " " if level else "- " if name.startswith("List") else "") + line)
    for table in body.findall(f"{_W}tbl"):
        out += ["| " + " | ".join(words(c) for c in row.findall(f"{_W}tc")) + " |" for row in table.findall(f"{_W}tr")]
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def docx_column(content: pd.Series) -> pd.Series:
    return content.map(docx_text, na_action="ignore")


def pages_column(pages_of: Callable[[bytes], list[str]]) -> Callable[[Column], Column]:
    """The pages of a file's content, by a provider such as a PDF reader; a file it cannot read has none, and null content does not reach it."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def read(contents: pd.Series) -> pd.Series:
        out = []
        for content in contents:
            try:
                out.append(None if content is None else list(pages_of(content)))
            except ValueError:
                out.append([])
        return pd.Series(out, dtype=object)

    return read


def with_pages(files: DataFrame, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """``files`` (with ``content``) and ``pages``."""
    return files.withColumn("pages", pages_column(pages_of)(F.col("content")))


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a golden set in JSON lines; blank lines are no cases."""
    return spark.read.schema(GOLDEN).json(path).filter("q is not null")


def feedback_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Ratings, one JSON object a line: as a table, or as a stream."""
    schema = "ts timestamp, corpus string, query string, chunk_id long, file string, path string, page int, kind string, rank int, rating string"
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append ratings; nothing is written if one of them is none of RATINGS or its corpus is no name."""
    bad = ~F.coalesce(F.col("rating").isin(*RATINGS) & F.col("corpus").rlike(f"^(?:{CORPUS_NAME})$"), F.lit(False))
    if not rows.filter(bad).isEmpty():
        raise ValueError(f"a rating is one of {', '.join(RATINGS)}, of a named corpus")
    rows.write.mode("append").json(path)


def looks_like_pdf(content: Column, size: Column, least: int = 51_200) -> Column:
    """Magic bytes and a size that an error page does not have."""
    return (F.substring(content, 1, 5) == F.lit(b"%PDF-")) & (size >= least)
