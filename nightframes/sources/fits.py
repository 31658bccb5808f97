"""FITS files as tables: listing, header cards, image units, scanlines.

Listing uses the binaryFile source and never reads file contents; the rest is read by the
data source of ``ranged``, headers and wanted lines only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import catalog as C
from nightframes.session import attach, staged
from nightframes.sources.ranged import SPLIT_BYTES, read_source

# Extensions of FITS files.
EXTENSIONS = ("fit", "fits", "fts", "fz")


# --- listing ------------------------------------------------------------------------


def is_fits_path(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1)).isin(*EXTENSIONS)


_LISTING = "path string, length bigint, modificationTime timestamp"


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """FITS files directly inside ``directory``: path, length, modificationTime.

    Contents are not read. A folder that cannot be read gives no rows. Order by path where
    a list is needed.
    """
    columns = ("path", "length", "modificationTime")
    try:
        found = _files(spark, [directory]).select(*columns)
    except Exception as error:  # a missing folder is an empty one
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], _LISTING)
    return found.filter(is_fits_path(F.col("path")))


def expand_inputs(spark: SparkSession, directories: list[str], files: list[str]) -> DataFrame:
    """Scanned folders and the named files that exist, whatever their extension."""
    out = [scan_directory(spark, d) for d in directories]
    for f in files:
        try:
            out.append(_files(spark, [f]).select("path", "length", "modificationTime"))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return reduce(DataFrame.unionByName, out, spark.createDataFrame([], _LISTING))


def file_stamps(files: DataFrame) -> DataFrame:
    """Length and modification time, the cheap identity of a file's contents."""
    return files.select("path", "length", F.col("modificationTime").alias("stamp"))


def file_hash(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SHA-256 of whole files."""
    return _files(spark, paths).select("path", F.sha2("content", 256).alias("sha256"))


# --- units and cards ----------------------------------------------------------------


def image_units(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per header/data unit of every file; only headers are read."""
    return read_source(spark, "units", paths)


def raw_cards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """80-column cards of each file's first image unit, right-trimmed: path, ord, card.

    Only headers are read, whatever the size of the file.
    """
    return read_source(spark, "cards", paths)


def cards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parsed cards: path, ord, name, value, vtype, comment."""
    return C.header_cards(raw_cards(spark, paths))


# --- samples ------------------------------------------------------------------------


def decoded_lines(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Scanlines of every readable file; an unreadable one gives a single row with ``error``.

    A file is cut into byte ranges of ``split_bytes``, each read by one task. Filters on
    ``path``, ``plane`` and ``y`` reach the files: only the lines they leave are read.
    """
    return read_source(spark, "lines", paths, split_bytes)


def frames(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Catalog and descriptor of every file with an image; frame_id is the path."""
    catalog = C.catalog(cards(spark, paths).withColumnRenamed("path", "frame_id"))
    sample_type = F.create_map(
        *[F.lit(x) for pair in S.BITPIX_TYPES.items() for x in pair]
    )
    has_planes = F.col("axes") == 3
    return catalog.select(
        F.col("frame_id"),
        F.col("frame_id").alias("path"),
        F.col("width").cast("int").alias("width"),
        F.coalesce("height", F.lit(1)).cast("int").alias("height"),
        F.col("axes").cast("int").alias("axes"),
        F.when(has_planes, F.col("planes")).otherwise(1).cast("int").alias("planes"),
        F.try_element_at(sample_type, F.col("bitpix").cast("int")).alias("sample_type"),
        S.default_scale(F.col("bscale")).alias("bscale"),
        S.default_zero(F.col("bzero")).alias("bzero"),
        *[c for c in catalog.columns if c not in "frame_id width height axes planes bscale bzero".split()],
    )


def scanlines(lines: DataFrame, frames: DataFrame) -> DataFrame:
    """Decoded lines with their frame's descriptor, ready to be written as a table.

    The descriptor is a few numbers per frame: lines stay where they are while it is small.
    """
    descriptor = frames.select(
        "frame_id", *"width height axes planes sample_type bscale bzero bayerpat".split()
    )
    found = lines.filter("error is null").drop("error").withColumnRenamed("path", "frame_id")
    return attach(found, staged(descriptor, "descriptor"), ["frame_id"], F.xxhash64("plane", "y"))


def read_errors(lines: DataFrame) -> DataFrame:
    return lines.filter("error is not null").select("path", "error")
