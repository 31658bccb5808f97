"""Box resize and the nine-region crop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframes.functions import scalars as S

# Tile side as a fraction of the short side, and its upper bound.
TILE_FRACTION = 0.10
TILE_MAX = 256


def fit_dimensions(width: Column, height: Column, max_w: Column, max_h: Column) -> Column:
    """Struct (width, height): the largest size inside the box with the same aspect."""
    scale = F.least(max_w / width, max_h / height)
    empty = (width <= 0) | (height <= 0) | (max_w <= 0) | (max_h <= 0)

    def side(n: Column) -> Column:
        scaled = F.greatest(S.half_away(n * scale).cast("int"), F.lit(1))
        return F.when(empty, 0).otherwise(scaled)

    return F.struct(side(width).alias("width"), side(height).alias("height"))


def _targets(s: Column, source: Column, dest: Column) -> tuple[Column, Column]:
    """First and last destination index a source index contributes to.

    Shrinking maps every source index to one destination; enlarging repeats it.
    """
    last = F.floor(((s + 1) * dest - 1) / source)
    first = F.when(dest <= source, last).otherwise(F.ceil(s * dest / source))
    return first, last


def resize(rgb: DataFrame, dest_w: Column, dest_h: Column) -> DataFrame:
    """Box resize: truncated mean of the source pixels of every destination pixel.

    Source pixels carry their destination, so it is one grouping with map-side sums and no
    join; enlarged frames repeat their pixels.
    """
    sized = rgb.withColumn("_dw", dest_w.cast("bigint")).withColumn("_dh", dest_h.cast("bigint"))
    x_first, x_last = _targets(F.col("x"), F.col("width"), F.col("_dw"))
    y_first, y_last = _targets(F.col("y"), F.col("height"), F.col("_dh"))
    placed = (
        sized.filter((F.col("_dw") > 0) & (F.col("_dh") > 0))
        .withColumn("dx", F.explode(F.sequence(x_first, x_last)))
        .withColumn("dy", F.explode(F.sequence(y_first, y_last)))
    )
    mean = [F.floor(F.sum(c) / F.count(F.lit(1))).cast("int").alias(c) for c in "rgb"]
    return (
        placed.groupBy("frame_id", "dy", "dx")
        .agg(F.first("_dw").cast("int").alias("width"), F.first("_dh").cast("int").alias("height"), *mean)
        .select(
            "frame_id",
            "width",
            "height",
            F.col("dy").cast("int").alias("y"),
            F.col("dx").cast("int").alias("x"),
            *"rgb",
        )
    )


def resize_to_fit(rgb: DataFrame, max_w: int, max_h: int) -> DataFrame:
    size = fit_dimensions(F.col("width"), F.col("height"), F.lit(max_w), F.lit(max_h))
    return resize(rgb, size["width"], size["height"])


def tile_size(width: Column, height: Column) -> Column:
    """Side of an inspection tile: a tenth of the short side, between 1 and 256."""
    short = F.least(width, height)
    tenth = S.half_away(short * TILE_FRACTION).cast("int")
    return F.greatest(F.least(tenth, F.lit(TILE_MAX), short), F.lit(1))


def _starts(side: Column, size: Column) -> list[Column]:
    room = F.greatest(side - size, F.lit(0))
    return [F.lit(0), F.floor(room / 2).cast("int"), room]


def regions(width: Column, height: Column, size: Column) -> Column:
    """Array of nine structs (region, x0, y0), row by row from the top left."""
    return F.array(
        *[
            F.struct(
                F.lit(row * 3 + col).alias("region"),
                x0.cast("int").alias("x0"),
                y0.cast("int").alias("y0"),
            )
            for row, y0 in enumerate(_starts(height, size))
            for col, x0 in enumerate(_starts(width, size))
        ]
    )


def frame_regions(frames: DataFrame) -> DataFrame:
    """Nine rows per frame with tile size and origin."""
    size = tile_size(F.col("width"), F.col("height"))
    return frames.select(
        "frame_id",
        size.alias("size"),
        F.explode(regions(F.col("width"), F.col("height"), size)).alias("t"),
    ).select("frame_id", "size", "t.*")


def crop_regions(rgb: DataFrame) -> DataFrame:
    """Pixels of the nine tiles: frame_id, region, ty, tx, r, g, b.

    Whether a pixel is in a tile follows from its position, so this is a filter and no
    join; only pixels inside some tile reach the explode.
    """
    w, h = F.col("width"), F.col("height")
    sized = rgb.withColumn("_size", tile_size(w, h))
    size, x, y = F.col("_size"), F.col("x"), F.col("y")

    def inside(pos: Column, start: Column) -> Column:
        return (pos >= start) & (pos < start + size)

    def in_any(pos: Column, side: Column) -> Column:
        a, b, c = (inside(pos, s) for s in _starts(side, size))
        return a | b | c

    hits = F.filter(
        regions(w, h, size), lambda t: inside(x, t["x0"]) & inside(y, t["y0"])
    )
    return (
        sized.filter(in_any(x, w) & in_any(y, h))
        .withColumn("t", F.explode(hits))
        .select(
            "frame_id",
            "t.region",
            (y - F.col("t.y0")).alias("ty"),
            (x - F.col("t.x0")).alias("tx"),
            *"rgb",
        )
    )
