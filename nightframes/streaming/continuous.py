"""Frames that keep arriving: metrics of new files, and session metrics by time window."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nightframes.operators import result_cache as C
from nightframes.session import staged


def watch_folder(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of FITS files arriving in ``directory`` with their stamp; contents unread."""
    from nightframes.sources.fits import is_fits_path

    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
    )
    return files.filter(is_fits_path(F.col("path"))).select(
        "path", "length", F.col("modificationTime").alias("stamp")
    )


def keep_metrics_current(
    files: DataFrame,
    cache_path: str,
    checkpoint: str,
    analyze: Callable[[DataFrame], DataFrame],
    family: str = "pixel",
) -> StreamingQuery:
    """Analyse the files of every micro-batch that the cache does not answer, and store them.

    ``analyze`` maps targets (path, length, stamp) to result rows with the cache's columns. A
    batch reads and writes only the buckets of its own paths, and repeated it replaces its
    own output.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        C.answer_batch(staged(batch, "targets"), cache_path, batch_id, analyze, family)

    return (
        files.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """Latest result per path, or None while nothing has been stored."""
    return C.read_results(spark, cache_path)


def rolling_metric(
    frames: DataFrame, time: str, value: str, window: str = "1 hour", delay: str | None = None
) -> DataFrame:
    """Mean of ``value`` per session and tumbling window of acquisition time.

    Works on a batch or a stream; a stream needs ``delay``, how late a frame may come.
    Windows without frames stay absent, so gaps in a session stay visible.
    """
    rows = frames.withWatermark(time, delay) if delay else frames
    return (
        rows.groupBy("session_id", F.window(time, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.avg(value).alias("mean_value"))
        .select("session_id", F.col("w.start").alias("window_start"), "frames", "mean_value")
    )


def write_stream(stream: DataFrame, folder: str, name: str) -> str:
    """Run ``stream`` over all input there is into Parquet below ``folder``; returns the path."""
    base = f"{folder}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return f"{base}/out"
