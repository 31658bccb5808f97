"""Statistics and star backgrounds of all frames from one grouping of their samples.

A sample is tagged by what it is for: the statistics of its frame, or the background of a
mosaic's half-size plane. Mono frames and cubes need no second tag: the plane their stars
are looked for on is what their statistics describe, so its median and MAD are theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import planes as P
from nightframes.operators import stats as A
from nightframes.session import matched, staged

FRAME, PLANE = "frame", "plane"
KEYS = ["frame_id", "kind"]


def tagged_samples(scanlines: DataFrame, planes: bool) -> DataFrame:
    """frame_id, kind, counted, key, scale, zero, saturation and the sample's place.

    ``key`` is what is counted: the raw sample of 8- and 16-bit frames, which ``scale`` and
    ``zero`` turn into a physical value, and a physical value of all others. ``counted`` says
    that a frame has few values. With ``planes`` mosaics also give their detection plane.
    """
    cube = S.is_rgb_cube(F.col("axes"), F.col("planes"), F.col("bayerpat"))
    is_float = F.col("sample_type").isin(*S.FLOAT_TYPES)
    ceiling = S.sample_saturation(F.col("sample_type"), F.col("bscale"), F.col("bzero"))
    top = F.when(cube & is_float, 65535.0).otherwise(ceiling)
    few = F.col("sample_type").isin(*A.COUNTED_TYPES) & (F.col("bscale") > 0)
    counted = F.when(cube, top.between(0.0, 65535.999)).otherwise(few)
    raw = F.col("raw").cast("double")
    value = S.physical(raw, F.col("bscale"), F.col("bzero"))
    whole = F.least(F.greatest(S.half_away(value), F.lit(0.0)), F.floor(top).cast("double"))
    key = (
        F.when(cube & is_float, S.round_clamped(value * 65535.0, 0.0, 65535.0))
        .when(cube & F.col("counted"), whole)
        .when(cube | ~F.col("counted"), value)
        .otherwise(raw)
    )
    plain = cube | ~F.col("counted")
    lines = scanlines.filter(~cube | (F.col("plane") == 1)).withColumn("counted", counted)
    frames = P.explode_samples(lines).select(
        "frame_id",
        F.lit(FRAME).alias("kind"),
        "counted",
        key.alias("key"),
        F.when(plain, 1.0).otherwise(F.col("bscale")).alias("scale"),
        F.when(plain, 0.0).otherwise(F.col("bzero")).alias("zero"),
        F.when(cube & F.col("counted"), F.floor(top).cast("double")).otherwise(ceiling).alias("saturation"),
        "plane",
        "y",
        "x",
    )
    if not planes:
        return frames
    rows = P.detection_rows(P.mosaics(scanlines))
    halves = rows.select("frame_id", "y", "bounded", "saturation", F.posexplode("values").alias("x", "key")).select(
        "frame_id",
        F.lit(PLANE).alias("kind"),
        F.col("bounded").alias("counted"),
        "key",
        F.lit(1.0).alias("scale"),
        F.lit(0.0).alias("zero"),
        "saturation",
        F.lit(0).alias("plane"),
        "y",
        "x",
    )
    return frames.unionByName(halves)


def shared_statistics(scanlines: DataFrame, planes: bool) -> tuple[DataFrame, DataFrame | None]:
    """Statistics per frame and, with ``planes``, ``median, mad`` of every detection plane; both staged."""
    samples = tagged_samples(scanlines, planes)
    groups = samples.filter("counted").groupBy(*KEYS, "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("scale", "zero", "saturation")]
    )
    v = S.physical(F.col("key"), F.col("scale"), F.col("zero"))
    counts = staged(groups.select(*KEYS, v.alias("v"), "n", "saturation"), "counts")

    def of(df: DataFrame, kind: str) -> DataFrame:
        return df.filter(F.col("kind") == kind).drop("kind")

    rows = counts.count()
    stats = A.stats_from_counts(of(counts, FRAME), rows=rows)
    halves = A.median_and_mad(of(counts, PLANE).filter(A.is_finite(F.col("v"))), rows=rows) if planes else None
    rest = samples.filter(~F.col("counted"))
    if not rest.isEmpty():
        ordered = A.in_order(rest, KEYS, "key")
        base, central = A.order_statistics(ordered, KEYS)
        stats = stats.unionByName(A.fields_in_order(of(ordered, FRAME), of(base, FRAME), of(central, FRAME)))
        if planes:
            halves = halves.unionByName(of(central, PLANE).filter("median is not null"))
    stats = staged(stats, "stats")
    if not planes:
        return stats, None
    # a frame's own median and MAD, except where its plane is another one
    halves = staged(halves, "halves")
    own = matched(stats.select("frame_id", "median", "mad"), halves.select("frame_id"), ["frame_id"], "left_anti")
    return stats, staged(own.unionByName(halves), "background")
