"""Frame tables on shared storage: frames, cards and scanlines as Parquet."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.operators import headers as H
from nightframes.operators import planes as P
from nightframes.session import attach, staged


def write_frames(
    path: str,
    frames: DataFrame,
    cards: DataFrame,
    scanlines: DataFrame,
    overwrite: bool = False,
) -> None:
    """Write the three tables below ``path``; existing output is refused unless asked.

    Scanlines are partitioned by sample type and sorted by frame, plane and y, so a wanted
    plane or frame is found by row-group statistics.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    frames.write.mode(mode).parquet(os.path.join(path, "frames"))
    cards.write.mode(mode).parquet(os.path.join(path, "cards"))
    (
        scanlines.repartitionByRange("sample_type", "frame_id", "plane", "y")
        .sortWithinPartitions("sample_type", "frame_id", "plane", "y")
        .write.mode(mode)
        .partitionBy("sample_type")
        .parquet(os.path.join(path, "scanlines"))
    )


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(path, name))


def write_rgb16(
    path: str,
    rgb: DataFrame,
    cards: DataFrame,
    history: str | None = None,
    overwrite: bool = False,
) -> None:
    """Store 16-bit RGB pixels as unsigned-16 cubes with their source's metadata."""
    from nightframes.operators.stretch import export_planes

    kept = H.output_cards(cards, 1.0, 32768.0, P.CFA_KEYWORDS)
    if history is not None:
        kept = H.add_history(kept, history)
    rgb = staged(rgb, "rgb")
    lines = P.to_scanlines(export_planes(rgb, "i16"))
    sizes = rgb.groupBy("frame_id").agg(
        F.first("width").alias("width"), F.first("height").alias("height")
    )
    described = sizes.select(
        "*",
        F.lit(3).alias("axes"),
        F.lit(3).alias("planes"),
        F.lit("I16").alias("sample_type"),
        F.lit(1.0).alias("bscale"),
        F.lit(32768.0).alias("bzero"),
        F.lit(None).cast("string").alias("bayerpat"),
    )
    described = staged(described, "described")
    lines = attach(lines, described, ["frame_id"], F.xxhash64("plane", "y"))
    write_frames(path, described, kept, lines, overwrite)
