"""Decisions about rows, laid beside the rows where they are.

A table that is read from files names each row by its file and its place in it. A
decision (keep it, take it twice) is a small row of that name; the task that scans a
file reads the decisions about that file alone. So texts are neither copied nor
shuffled to drop or repeat some of them, however many decisions there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from spindrift.session import bound_batches, new_shared_path, open_store, written

#: The name of a row: hash of its file's path, number in the file.
PLACE = T.StructType([T.StructField("file", T.LongType()), T.StructField("row", T.LongType())])
#: Decisions in one folder, about.
FOLDER_ROWS = 1_000_000


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def _place(docs: DataFrame):
    at = docs.metadataColumn("_metadata")
    return F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].cast("long").alias("row"))


def in_files(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` if its rows are rows of files, each once; else a written copy."""
    try:
        places = docs.select(_place(docs).alias("p"))
        if places.distinct().count() == places.count():
            return docs
    except AnalysisException:  # the plan has no files, or no longer
        pass
    return written(docs, name, keep=True)


def with_place(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` (of :func:`in_files`) and the name of each row, a PLACE."""
    return docs.withColumn(name, _place(docs))


def beside(
    docs: DataFrame, decisions: DataFrame, name: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of ``docs`` (of :func:`in_files`) that ``decisions`` (``place, value`` long, one per place at most) names, and the value.

    The decisions are written by hash of the file; a task reads those about the files that
    it scans, 16 bytes for each of a file's rows. ``then`` maps the batches further in the same worker, to ``schema``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = new_shared_path(spark, "decisions")
    folders = max(1, -(-decisions.count() // FOLDER_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder_of = lambda file: F.pmod(file, F.lit(folders)).cast("int")
    flat = decisions.select(F.col("place.file").alias("file"), F.col("place.row").alias("row"), "value").withColumn("part", folder_of(F.col("file")))
    flat.repartition(folders, "part").sortWithinPartitions("part", "file", "row").write.partitionBy("part").parquet(folder)

    columns = docs.columns
    place, row_no, part = unused(columns, "place", "row_no", "part")
    named = with_place(docs, place)
    named = named.select(*columns, F.col(place)["file"].alias(place), F.col(place)["row"].alias(row_no)).withColumn(part, folder_of(F.col(place)))
    n = len(columns)

    def about(file: int, part_no: int) -> tuple[np.ndarray, np.ndarray]:
        store, root = open_store(f"{folder}/part={part_no}")
        if store.get_file_info(root).type == fs.FileType.NotFound:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = pyarrow.dataset.dataset(root, filesystem=store, format="parquet").to_table(["row", "value"], filter=pyarrow.dataset.field("file") == file)
        rows, values = (found.column(k).to_numpy() for k in (0, 1))
        order = np.argsort(rows)
        return rows[order], values[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            file, row, part_no = (batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(3))
            kept, value = np.zeros(len(batch), bool), np.zeros(len(batch), np.int64)
            for f, first in zip(*np.unique(file, return_index=True)):
                if f not in known:
                    known = {f: about(int(f), int(part_no[first]))}  # a task scans one file after another
                rows, values = known[f]
                own = np.flatnonzero(file == f)
                at = np.searchsorted(rows, row[own])
                there = at < len(rows)
                there[there] = rows[at[there]] == row[own][there]
                kept[own], value[own[there]] = there, values[at[there]]
            out = pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(value)], names=[*columns, name])
            out = out.filter(pa.array(kept))
            yield then(out) if then else out

    return named.mapInArrow(run, schema or T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
