"""Stored results by path, in buckets, so that a batch touches only the buckets of its paths.

``<cache>/bucket=<b>/batch=<n>`` holds what batch ``n`` stored for paths of bucket ``b``; of a
path's rows the one of the last batch counts. A batch that is repeated replaces its own
output. A bucket with many versions is brought down to one before more are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.operators import incremental as N
from nightframes.session import staged

# Buckets of a new cache; versions of a bucket beyond which it is put together.
BUCKETS = 64
MOST_VERSIONS = 8


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def buckets_of(rows: DataFrame) -> list[int]:
    """Buckets of the rows' paths: at most BUCKETS numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(F.col("path"))).distinct().collect())


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, cache_path: str, bucket: int) -> list[int]:
    """Batches that have stored something in a bucket, from the first on."""
    store, folder = _folder(spark, f"{cache_path}/bucket={bucket}")
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))


def read_results(
    spark: SparkSession, cache_path: str, buckets: list[int] | None = None, before: int | None = None
) -> DataFrame | None:
    """The last result of every path, or None while there is none.

    With ``buckets`` only their folders are listed and read; with ``before`` what that batch
    and later ones stored does not count.
    """
    store, root = _folder(spark, cache_path)
    if not store.exists(root):
        return None
    if buckets is None:
        names = [s.getPath().getName() for s in store.listStatus(root)]
        buckets = [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]
    folders = [
        f"{cache_path}/bucket={b}/batch={v}"
        for b in buckets
        for v in versions(spark, cache_path, b)
        if before is None or v < before
    ]
    if not folders:
        return None
    rows = spark.read.option("basePath", cache_path).option("mergeSchema", True).parquet(*folders)
    columns = [c for c in rows.columns if c not in ("bucket", "batch", "path")]
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return latest.select("path", "r.*")


def write_results(results: DataFrame, cache_path: str, batch: int) -> None:
    """Store a batch's results but errors, one row per path; only buckets of its paths are written."""
    good = results.filter(F.col("status") != N.ERROR)
    placed = good.withColumns({"bucket": bucket_of(F.col("path")), "batch": F.lit(batch).cast("bigint")})
    (
        placed.repartition("bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket", "batch")
        .parquet(cache_path)
    )


def compact(spark: SparkSession, cache_path: str, buckets: list[int], before: int) -> list[int]:
    """Bring buckets with more than MOST_VERSIONS versions before ``before`` down to one; returns them.

    The last of those versions takes over all rows, then the others go, so a batch that is
    repeated, or a run that ends half way, finds every row.
    """
    done = []
    for bucket in buckets:
        old = [v for v in versions(spark, cache_path, bucket) if v < before]
        if len(old) <= MOST_VERSIONS:
            continue
        rows = staged(read_results(spark, cache_path, [bucket], before), "compacted")
        target = f"{cache_path}/bucket={bucket}/batch={old[-1]}"
        rows.coalesce(1).write.mode("overwrite").parquet(target)
        for version in old[:-1]:
            store, folder = _folder(spark, f"{cache_path}/bucket={bucket}/batch={version}")
            store.delete(folder, True)
        done.append(bucket)
    return done


def answer_batch(targets: DataFrame, cache_path: str, batch: int, analyze, family: str = "pixel") -> list[int]:
    """Analyse the targets that the cache does not answer and store them; returns the buckets touched.

    ``targets`` is a staged table of path, length, stamp; ``analyze`` maps such rows to
    results with the cache's columns.
    """
    spark = targets.sparkSession
    touched = buckets_of(targets)
    if not touched:
        return touched
    compact(spark, cache_path, touched, batch)
    kept = read_results(spark, cache_path, touched, before=batch)
    work = targets if kept is None else N.todo(N.plan_batch(targets, kept, family))
    write_results(analyze(work), cache_path, batch)
    return touched
