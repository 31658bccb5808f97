"""Automatic stretch: median and MAD per channel, then a midtones transfer per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import planes as P
from nightframes.operators.stats import median_and_mad
from nightframes.session import SALTS, attach, dealt, staged

# Shadows clip in MADs below the median, default background level, and the
# gap kept between the midtone and the ends of (0, 1).
SHADOWS_CLIP = -2.8
DEFAULT_BRIGHTNESS = 0.25
EPSILON = 2.0**-23
# Neighbouring lines of a frame that are counted together.
SLICE_LINES = 64


def mtf(m: Column, x: Column) -> Column:
    """Midtones transfer function: 0 at 0, 1 at 1 and one half at ``m``."""
    curve = ((m - 1.0) * x) / ((2.0 * m - 1.0) * x - m)
    return (
        F.when(x <= 0.0, 0.0)
        .when(x >= 1.0, 1.0)
        .when(F.abs(x - m) < EPSILON, 0.5)
        .otherwise(curve)
    )


def transfer(v: Column, shadows: Column, midtones: Column) -> Column:
    """Rescale above the shadows clip, then apply the midtones curve."""
    span = 1.0 - shadows
    rescaled = F.when(span > 0.0, S.clamp((v - shadows) / span, 0.0, 1.0)).otherwise(0.0)
    return mtf(midtones, rescaled)


def channel_counts(rgb: DataFrame, linked: bool = False) -> DataFrame:
    """Counts of normalised values per frame and channel (channel -1 when linked).

    ``rgb`` must be a staged table: what a task counts follows its rows, not its bytes, as a
    few bytes of compressed pixels give very many counts. Pixels are dealt by slices of their
    frame and counted there; a value has one count for each slice, which ranks do not mind.
    """
    lines = F.pmod(F.expr(f"y div {SLICE_LINES}"), F.lit(SALTS)).alias("slice")
    rgb = dealt(rgb.select("frame_id", lines, *"rgb", "depth"), ["frame_id", "slice"], rgb.count())
    channels = F.array(
        *[
            F.struct(F.lit(-1 if linked else i).alias("channel"), F.col(c).alias("s"))
            for i, c in enumerate("rgb")
        ]
    )
    top = F.when(F.col("depth") == 8, 255.0).otherwise(65535.0)
    # Count the integer samples; normalising happens once per distinct value.
    return (
        rgb.select("frame_id", "slice", "depth", F.explode(channels).alias("c"))
        .groupBy("frame_id", "slice", "c.channel", "c.s")
        .agg(F.count(F.lit(1)).alias("n"), F.first("depth").alias("depth"))
        .select("frame_id", "channel", (F.col("s") / top).alias("v"), "n")
    )


def stretch_params(
    rgb: DataFrame, linked: bool = False, brightness: float = DEFAULT_BRIGHTNESS
) -> DataFrame:
    """``shadows, midtones`` per frame and channel; the pixels are staged."""
    return _params(staged(rgb.select("frame_id", "y", *"rgb", "depth"), "rgb"), linked, brightness)


def _params(rgb: DataFrame, linked: bool, brightness: float) -> DataFrame:
    target = F.lit(S.check_brightness(brightness))
    keys = ["frame_id", "channel"]
    stats = median_and_mad(channel_counts(rgb, linked), keys)
    shadows = S.clamp(F.col("median") + SHADOWS_CLIP * F.col("mad"), 0.0, 1.0)
    midtones = S.clamp(mtf(target, F.col("median") - F.col("shadows")), EPSILON, 1.0 - EPSILON)
    return stats.withColumn("shadows", shadows).withColumn("midtones", midtones)


def auto_stretch(
    rgb: DataFrame, linked: bool = False, brightness: float = DEFAULT_BRIGHTNESS
) -> DataFrame:
    """Stretched RGB pixels with 16-bit samples; other columns are kept.

    The pixels are staged, as both the parameters and the transfer need them; the parameters
    are a few numbers per frame, staged once and joined back.
    """
    rgb = staged(rgb, "rgb")
    params = _params(rgb, linked, brightness)
    wide = staged(
        params.groupBy("frame_id").agg(
            *[
                F.first(
                    F.when(F.col("channel").isin(i, -1), F.struct("shadows", "midtones")),
                    ignorenulls=True,
                ).alias(f"_{c}")
                for i, c in enumerate("rgb")
            ]
        ),
        "params",
    )
    top = F.when(F.col("depth") == 8, 255.0).otherwise(65535.0)
    joined = attach(rgb, wide, ["frame_id"], F.col("y"))
    out = {}
    for c in "rgb":
        value = transfer(F.col(c) / top, F.col(f"_{c}.shadows"), F.col(f"_{c}.midtones"))
        out[c] = S.round_to_u16(value * 65535.0)
    return joined.withColumns(out).withColumn("depth", F.lit(16)).drop("_r", "_g", "_b")


def load_and_stretch(
    scanlines: DataFrame,
    pattern: str | None = None,
    force: bool = False,
    linked: bool = False,
    brightness: float = DEFAULT_BRIGHTNESS,
) -> DataFrame:
    return auto_stretch(P.load_rgb(scanlines, pattern, force), linked, brightness)


def render(
    scanlines: DataFrame,
    debayer: bool = True,
    stretch: bool = True,
    pattern: str | None = None,
    force: bool = False,
    brightness: float = DEFAULT_BRIGHTNESS,
    linked: bool = False,
) -> DataFrame:
    """RGB pixels as shown or exported, with ``source`` saying how they came about.

    With ``debayer`` off a mosaic is shown as grey; frames that are already debayered are
    loaded as usual.
    """
    if debayer:
        rgb = P.load_rgb(scanlines, pattern, force).withColumnRenamed("notice", "source")
    else:
        done = P.cubes(scanlines).unionByName(P.monos(scanlines))
        raw = P.load_mono_raw(P.mosaics(scanlines))
        rgb = (
            P.load_rgb(done, pattern, force)
            .withColumnRenamed("notice", "source")
            .unionByName(raw.withColumn("source", F.lit("RawMono")))
        )
    return auto_stretch(rgb, linked, brightness) if stretch else rgb


def export_planes(rgb: DataFrame, target: str) -> DataFrame:
    """RGB pixels as planar samples stored as ``i8``, ``i16`` or ``f32``, with ``bzero``."""
    raw, bzero = S.export_sample(S.to_output_depth(F.col("v"), F.col("depth"), 16), target)
    return P.deinterleave(rgb).select(
        "frame_id", "plane", "y", "x", raw.alias("raw"), F.lit(bzero).alias("bzero")
    )
