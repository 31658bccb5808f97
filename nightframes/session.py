"""Session set-up, the shared folder for intermediate tables, and the per-frame join."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A per-frame table with at most this many rows is sent to every executor. Its rows are
# a handful of fixed-width numbers (under 200 bytes), so the bound is about 40 MB.
BROADCAST_ROWS = 200_000
# Number of slices one frame's rows are cut into when the per-frame table is too large
# for that and both sides have to be shuffled.
SALTS = 16
# Rows of about a hundred bytes that one task sorts or groups at a time.
TASK_ROWS = 250_000


def build_session(app: str = "nightframes", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(module: str) -> None:
    """Send the module's functions to Python workers by value.

    Executors then need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext.getCheckpointDir()
        path = current[: current.rstrip("/").rfind("/")] if current else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no lineage, survives the loss of executors, is computed once however
    often it is used, and has a size Spark knows when it plans the next join.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``rows`` with those of a key in one partition, as many partitions as ``count`` rows ask for.

    Spark merges partitions up to a size in compressed bytes, which for narrow rows may be
    millions of them; a number that was asked for is kept.
    """
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
    return rows.repartition(tasks, *keys)


def gathered(rows: DataFrame, keys: list[str], total: int, most: int) -> DataFrame:
    """``rows`` dealt by key where no key has more than one task's; else the same DataFrame.

    ``total`` is the number of rows, ``most`` that of the largest key. Grouping on the map side
    makes large keys small. Of small keys that lie apart a task holds a group for nearly every
    row it reads, and how many these are follows from the splits and not from ``TASK_ROWS``.
    """
    if most > TASK_ROWS or total <= TASK_ROWS:
        return rows
    return dealt(rows, keys, total)


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the frames: both are shuffled, neither is broadcast.

    Spark judges a table by the bytes of its files. A few MB of repeated values may be millions
    of rows, or gigabytes of lists, and what is broadcast passes through the driver whole.
    """
    return left.join(right.hint("merge"), on, how)


def attach(
    rows: DataFrame,
    per_frame: DataFrame,
    on: list[str],
    spread: Column,
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    count: int | None = None,
) -> DataFrame:
    """Join pixel-sized ``rows`` with a small table that has one row per key.

    ``per_frame`` must be a staged table, counted by its footers, or ``count`` is given. Up to
    ``broadcast_rows`` it is broadcast and ``rows`` stay where they are. Beyond that both
    sides are shuffled on (key, slice of ``spread``), so that a frame holding a large part
    of all rows is cut into ``SALTS`` pieces instead of landing in one task.
    """
    if (per_frame.count() if count is None else count) <= broadcast_rows:
        return rows.join(F.broadcast(per_frame), on, how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    salted_frames = per_frame.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    )
    return matched(salted_rows, salted_frames, [*on, "_salt"], how).drop("_salt")
