"""Logs as streams: windowed counts with late data, first ratings, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spindrift.session import new_shared_path


def windowed(stream: DataFrame, ts: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """``start, rating, n`` of tumbling windows (sliding ones with ``slide``); rows later than ``late`` do not count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, late).groupBy(w.alias("w"), F.col(key).alias("rating")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "rating", "n")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """``start, end, key, n`` of runs of rows of a key with no pause of ``gap``."""
    counted = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_ratings(stream: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """The stream without repeats of a rating inside the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(query: DataFrame) -> DataFrame:
    """Run a streaming query in append mode over all that is there and return what it has written to the shared folder.

    A window is written once, when the watermark has passed its end, and leaves the state then; those that are
    still open stay in the checkpoint for the next run.
    """
    spark = query.sparkSession
    path = new_shared_path(spark, "stream")
    sink = query.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(query.schema).parquet(f"{path}/rows")
