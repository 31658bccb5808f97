"""Frame analysis and incremental runs against a stamped result table.

The result table (``cache``) has one row per path: ``path, length, stamp, status,
stars_measured`` and the metrics. ``status`` is analyzed, skipped_no_date or error; errors
are never kept, so a half-written file is tried again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframes.operators import catalog as C
from nightframes.operators import measure as M
from nightframes.operators import planes as P
from nightframes.operators import stars as D
from nightframes.operators import stats as A
from nightframes.session import attach, dealt, matched, staged

ANALYZED, SKIPPED, ERROR = "analyzed", "skipped_no_date", "error"


def satisfies(status: Column, stars_measured: Column, family: str) -> Column:
    """Whether a kept result answers ``family``: star results answer both families."""
    if family not in ("pixel", "star"):
        raise ValueError("family must be pixel or star")
    measured = F.coalesce(stars_measured, F.lit(False)) if family == "star" else F.lit(True)
    return F.coalesce((status == SKIPPED) | ((status == ANALYZED) & measured), F.lit(False))


def plan_batch(targets: DataFrame, cache: DataFrame, family: str) -> DataFrame:
    """Every target with ``action``: metrics (kept result usable), no_date or todo.

    ``targets`` holds ``path, length, stamp`` and possibly ``ord``. One left join by path; a
    result counts only if both parts of the stamp still agree.
    """
    known = cache.select(
        "path",
        F.col("length").alias("_length"),
        F.col("stamp").alias("_stamp"),
        F.col("status").alias("_status"),
        F.col("stars_measured").alias("_measured"),
    )
    joined = targets.join(known, "path", "left")
    fresh = (
        satisfies(F.col("_status"), F.col("_measured"), family)
        & F.coalesce(F.col("length") == F.col("_length"), F.lit(False))
        & F.coalesce(F.col("stamp") == F.col("_stamp"), F.lit(False))
    )
    action = (
        F.when(~fresh, "todo").when(F.col("_status") == SKIPPED, "no_date").otherwise("metrics")
    )
    return joined.withColumn("action", action).select(*targets.columns, "action")


def todo(plan: DataFrame) -> DataFrame:
    return plan.filter("action = 'todo'").drop("action")


def upsert(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with ``results`` put in by path; errors are left out."""
    good = results.filter(F.col("status") != ERROR)
    return cache.join(good.select("path"), "path", "left_anti").unionByName(
        good, allowMissingColumns=True
    )


def replace_paths(working: DataFrame, cache: DataFrame, moved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply ``moved`` (old_path, new_path): working set renamed, old results dropped."""
    renamed = (
        working.join(moved.withColumnRenamed("old_path", "path"), "path", "left")
        .withColumn("path", F.coalesce("new_path", "path"))
        .drop("new_path")
    )
    kept = cache.join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return renamed, kept


def measure_frames(
    scanlines: DataFrame, frames: DataFrame, pixel_stats: bool = True, stars: bool = False
) -> DataFrame:
    """Requested measurements per frame: statistics, star metrics, or both.

    Asked for together they share the samples' counts: stars of mono frames and cubes are
    looked for above the median and MAD of their statistics, and mosaics' planes are counted
    along with the frames. Branches not asked for are not planned. A frame stars cannot be
    detected on keeps its statistics and gets ``star_error``.
    """
    out = frames.select("frame_id")
    background = None
    if pixel_stats:
        stats, background = M.shared_statistics(scanlines, planes=stars)
        out = matched(out, stats, ["frame_id"], "left")
    if stars:
        found = D.detect_stars(scanlines, frames, background=background)
        errors = P.detection_errors(frames).withColumnRenamed("error", "star_error")
        out = matched(matched(out, found, ["frame_id"], "left"), errors, ["frame_id"], "left")
    return out


def analyze_frames(
    scanlines: DataFrame, frames: DataFrame, stars: bool = False, read_errors: DataFrame | None = None
) -> DataFrame:
    """Analysis outcome per frame: status, time key, statistics and optional star metrics.

    ``frames`` holds the descriptor, ``path, session_id, date_loc, date_obs``. Frames without
    a usable time are skipped before any pixel is read; with ``stars`` a shape detection
    cannot handle is an error, as is every row of ``read_errors`` (path, error).
    """
    if read_errors is not None:
        frames = frames.join(read_errors.select("path"), "path", "left_anti")
    timed = frames.withColumns(
        dict(zip(("time", "time_str"), C.acquisition_time(F.col("date_loc"), F.col("date_obs"))))
    )
    usable = timed.filter(F.col("time").isNotNull())
    keys = staged(usable.select("frame_id"), "usable")
    samples = attach(scanlines, keys, ["frame_id"], F.xxhash64("plane", "y"), "left_semi")
    measured = measure_frames(samples, usable, True, stars)
    if not stars:
        measured = measured.withColumn("star_error", F.lit(None).cast("string"))
    described = timed.select("frame_id", "path", "session_id", "time", "time_str")
    out = described.join(measured, "frame_id", "left")
    status = (
        F.when(F.col("time").isNull(), SKIPPED)
        .when(F.col("star_error").isNotNull(), ERROR)
        .otherwise(ANALYZED)
    )
    out = (
        out.withColumn("status", status)
        .withColumnRenamed("star_error", "error")
        .withColumn("stars_measured", F.lit(stars))
    )
    if read_errors is not None:
        failed = read_errors.select("path", "error").withColumn("status", F.lit(ERROR))
        out = out.unionByName(failed, allowMissingColumns=True)
    return out


def outcome_counts(results: DataFrame, keys: list[str] = []) -> DataFrame:
    """Processed, ok, skipped and failed rows."""
    status = F.col("status")
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(status == ANALYZED).alias("ok"),
        F.count_if(status == SKIPPED).alias("skipped"),
        F.count_if(status == ERROR).alias("failed"),
    )


def result_view(results: DataFrame, summary: DataFrame) -> DataFrame:
    """Series summary per session and metric next to the session's skipped and failed frames."""
    counts = outcome_counts(results, ["session_id"]).select("session_id", "skipped", "failed")
    return counts.join(summary, "session_id", "left")


def document_bundle(frames: DataFrame, cards: DataFrame, measured: DataFrame) -> DataFrame:
    """Everything shown for a frame, one row each: cards, summary, statistics, heights, stars, channel tag.

    ``frames`` holds the descriptor, ``cards`` (frame_id, ord, name, value, comment) the
    headers, ``measured`` what ``measure_frames`` gives for both families. ``cards`` is an
    array in header order, ``summary`` an array of label and value in the summary's order;
    both are as long as one header. A frame without cards has empty ones.
    """
    cards = staged(cards, "cards")
    rows = cards.count()
    card = F.struct("ord", "name", F.coalesce("value", F.lit("")).alias("value"), "comment")
    headers = dealt(cards, ["frame_id"], rows).groupBy("frame_id").agg(F.array_sort(F.collect_list(card)).alias("cards"))
    headers = headers.withColumn(
        "cards", F.transform("cards", lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"), c["comment"].alias("comment")))
    )
    lines = C.summary(C.catalog(cards, rows)).groupBy("frame_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "label", "value"))).alias("summary")
    )
    lines = lines.withColumn(
        "summary", F.transform("summary", lambda f: F.struct(f["label"].alias("label"), f["value"].alias("value")))
    )
    parts = [P.with_shape(frames).select("frame_id", "shape"), headers, lines, measured]
    joined = reduce(lambda a, b: a.join(b, "frame_id", "left"), parts)
    return joined.select(
        "frame_id",
        F.when(F.col("shape") == "rgb_cube", "G").alias("channel"),
        F.coalesce("cards", F.array().cast(headers.schema["cards"].dataType)).alias("cards"),
        F.coalesce("summary", F.array().cast(lines.schema["summary"].dataType)).alias("summary"),
        *"min max mean median sigma mad zeros".split(),
        A.histogram_heights(F.col("histogram")).alias("heights"),
        *"star_count hfr fwhm eccentricity star_error".split(),
    )
