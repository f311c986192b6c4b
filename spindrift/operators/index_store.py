"""The stored index: tables by corpus, what changed, copy-on-write updates, checks and counts."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spindrift.functions import text as X
from spindrift.operators import graph, inverted

SCHEMA_VERSION = 5
CORPUS_NAME = re.compile(r"[a-z0-9][a-z0-9_-]*")
#: Keys of the tables; a later row replaces an earlier one of the same key.
KEYS = {
    "files": ("corpus", "path"),
    "chunks": ("corpus", "path", "section_id", "piece_no"),
    "sections": ("corpus", "path", "section_id"),
    "raw_refs": ("corpus", "path", "src_section_id", "dst_raw", "dst_kind"),
    "refs": ("corpus", "path", "src_section_id", "dst_raw", "dst_kind"),
}


def check_corpus(name: str) -> str:
    if not CORPUS_NAME.fullmatch(name):
        raise ValueError(f"no corpus name: {name!r}")
    return name


def changes(disk: DataFrame, indexed: DataFrame, full: bool = False) -> DataFrame:
    """``corpus, path, action`` of files on disk (``corpus, path, sha256``) and in the index: new, changed, same or gone.

    Reads only; nothing is purged before the new rows are there. ``full`` calls every file that is there changed.
    """
    d = disk.select("corpus", "path", F.col("sha256").alias("d_sha"))
    i = indexed.select("corpus", "path", F.col("sha256").alias("i_sha"))
    rows = d.join(i, ["corpus", "path"], "full_outer")
    same = (F.col("d_sha") == F.col("i_sha")) & F.lit(not full)
    action = F.when(F.col("d_sha").isNull(), "gone").when(F.col("i_sha").isNull(), "new").when(same, "same").otherwise("changed")
    return rows.select("corpus", "path", action.alias("action"))


def build_plan(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, characters, estimated tokens and cost of embedding, and whether to ask first."""
    total = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(X.embed_guard("embed_input"))), F.lit(0)).alias("chars"))
    rows = total.crossJoin(F.broadcast(files.agg(F.countDistinct("corpus", "path").alias("files"))))  # one row each
    rows = rows.withColumn("tokens", X.tokens_of(F.col("chars"))).withColumn("usd", X.usd_of(F.col("tokens")))
    return rows.withColumn("ask", F.col("usd") > X.USD_LIMIT)


def replaced(old: DataFrame, new: DataFrame, touched: DataFrame, keys: tuple[str, ...] = ("corpus", "path")) -> DataFrame:
    """The old rows without those of the touched files, and the new ones."""
    return old.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def purged(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("corpus", "path").distinct(), ["corpus", "path"], "left_anti")


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``corpus, table_name, n`` for each table."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("corpus").agg(F.count("*").alias("n")).select("corpus", F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.union(part)
    return out


def check_chunks(chunks: DataFrame) -> None:
    """An error if a chunk has no text or no vector, or if vectors differ in length."""
    size = F.size("embedding")
    bad = F.col("embedding").isNull() | (F.coalesce(F.length("text"), F.lit(0)) == 0)
    row = chunks.agg(F.count_if(bad).alias("bad"), F.min(size).alias("least"), F.max(size).alias("most")).first()
    if row["bad"] or row["least"] != row["most"]:
        raise ValueError(f"{row['bad']} chunks without text or vector; vectors of {row['least']} to {row['most']} numbers")


def one_each(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a table, one of each key: of several the last in the order of all columns, so that reruns agree."""
    keys = KEYS[name]
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("last")).select(*keys, "last.*").select(*rows.columns)


class IndexStore:
    """Tables below a root, by corpus, each in folders of versions: a commit writes new versions and then one pointer row.

    Readers take the version that the pointer names, so that a build that dies leaves the last
    state, and a table is never overwritten while it is read. The pointer holds the schema, so that a table without rows
    can be read, and the folder, whose name no other commit uses: of two writers at once each leaves a whole state, and
    all readers take the same one. The version before the last is kept for readers that have begun; older ones are removed.
    With the chunks goes their inverted index, built once a commit.
    """

    POINTERS = "table_name string, corpus string, version long, schema_version int, columns string, folder string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(f"{self.root}/_pointers")
        return fs.exists(p)

    def _pointers(self) -> DataFrame:
        rows = self.spark.read.schema(self.POINTERS).json(f"{self.root}/_pointers")
        old = F.format_string("%s/corpus=%s/v%d", "table_name", "corpus", "version")
        return rows.withColumn("folder", F.concat(F.lit(self.root + "/"), F.coalesce("folder", old)))

    def _current(self) -> dict[tuple[str, str], tuple[int, int, str, str]]:
        """Version, schema version, columns and folder of each table and corpus: a few rows."""
        if not self.exists():
            return {}
        last = self._pointers().groupBy("table_name", "corpus").agg(F.max(F.struct("version", "schema_version", "columns", "folder")).alias("x"))
        return {(r["table_name"], r["corpus"]): tuple(r["x"]) for r in last.collect()}

    def corpora(self) -> list[str]:
        return sorted({c for _, c in self._current()})

    def names(self, corpus: str) -> set[str]:
        """The tables that a corpus has."""
        return {n for n, c in self._current() if c == corpus}

    def schema_outdated(self, corpus: str) -> bool:
        return any(v[1] != SCHEMA_VERSION for (_, c), v in self._current().items() if c == corpus)

    def read(self, name: str, corpus: str | None = None) -> DataFrame:
        """A table of one corpus, or of all: only the folders of the corpus are read."""
        out = None
        for (table, c), (_, _, columns, folder) in sorted(self._current().items()):
            if table == name and corpus in (None, c):
                schema = T.StructType.fromJson(json.loads(columns))
                stored = T.StructType([f for f in schema.fields if f.name != "corpus"])
                part = self.spark.read.schema(stored).parquet(folder).withColumn("corpus", F.lit(c)).select(*schema.names)
                out = part if out is None else out.unionByName(part)
        if out is None:
            raise FileNotFoundError(f"no table {name}{f' of {corpus}' if corpus else ''} in {self.root}")
        return out

    def inverted(self, corpus: str) -> inverted.Inverted:
        """The inverted index of a corpus's chunks."""
        return inverted.opened(self.spark, self._current()["inverted", corpus][3])

    def commit(self, corpus: str, tables: dict[str, DataFrame]) -> None:
        """Write new versions of the tables of one corpus, and point to them; other corpora are not touched."""
        current, rows = self._current(), []
        own = uuid.uuid4().hex[:12]

        def add(name: str, columns: str) -> str:
            v = current.get((name, corpus), (0,))[0] + 1
            rows.append((name, corpus, v, SCHEMA_VERSION, columns, f"{name}/corpus={corpus}/v{v}/{own}"))
            return f"{self.root}/{rows[-1][-1]}"

        for name, df in tables.items():
            df.filter(F.col("corpus") == corpus).drop("corpus").write.parquet(add(name, df.schema.json()))
        if "chunks" in tables:
            chunks = self.spark.read.schema(tables["chunks"].schema).parquet(f"{self.root}/{next(r[-1] for r in rows if r[0] == 'chunks')}")
            inverted.build(chunks, meta_col="meta", folder=add("inverted", ""))
        self.spark.createDataFrame(rows, self.POINTERS).coalesce(1).write.mode("append").json(f"{self.root}/_pointers")
        for name, _, v, *_ in rows:
            if v > 2:
                fs, p = self._fs(f"{self.root}/{name}/corpus={corpus}/v{v - 2}")
                fs.delete(p, True)

    def purge(self, paths: DataFrame) -> None:
        """Remove all rows of files (``corpus, path``) from all tables; references that asked for their sections are resolved anew."""
        for corpus in [r[0] for r in paths.select("corpus").distinct().collect()]:
            left = {n: purged(self.read(n, corpus), paths) for n, c in self._current() if c == corpus and n != "inverted"}
            if {"raw_refs", "ref_keys", "refs"} <= left.keys():
                left["refs"] = graph.propagate(self.read("refs", corpus), left["raw_refs"], self.read("ref_keys", corpus), left["ref_keys"], paths)
            elif {"raw_refs", "sections"} <= left.keys():
                left["refs"] = graph.resolve_refs(left["raw_refs"], left["sections"])
            self.commit(corpus, left)
