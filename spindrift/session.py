"""Session helpers: builder defaults and tables written to the shared folder.

A cluster names one folder that the driver and all executors share in
``spark.checkpoint.dir``. Intermediate tables go there and nowhere else, so that
a lost executor costs a re-read and not the job. Where the setting is absent, a
local session (tests, a laptop) uses a temporary folder of this process; a cluster,
whose executors would not see it, gets an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_scratch: ContextVar[str | None] = ContextVar("_scratch", default=None)


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.master(f"local[{cpus}]")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="spindrift-"))
    return _fallback[0]


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a reader of it.

    This cuts the lineage: what reads the result never recomputes ``df``, and two
    readers see the same rows. The files stay until the application's folder is removed or,
    unless told to ``keep`` them, until the end of the :func:`scratch` that they are written in.
    """
    spark = df.sparkSession
    within = None if keep else _scratch.get()
    path = f"{within}/{name}-{uuid.uuid4().hex[:12]}" if within else new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder for the tables that :func:`written` writes inside; they are removed at the end: what is returned must not read them."""
    path = new_shared_path(spark, name)
    before = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(before)
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what is written inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, for tasks that read or write files there, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send Arrow batches of ``rows`` rows to Python, unless the session names a number of its own.

    The default of 10,000 is made for numbers; that many whole texts are tens of megabytes, which
    a batch holds several times over, in the JVM and in each worker. The plan is made when a result is
    asked for, so the setting holds for the rest of the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
