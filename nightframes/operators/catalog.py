"""Frame catalog: typed header projection, summary rows, working sets, content hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.session import dealt, ship, staged

ship(__name__)

# How a file stores each sample type.
_ENCODED = {"U8": ">u1", "I16": ">i2", "I32": ">i4", "I64": ">i8", "F32": ">f4", "F64": ">f8"}

# Catalog column, header keyword and type.
CATALOG_FIELDS = (
    ("bitpix", "BITPIX", "bigint"),
    ("axes", "NAXIS", "bigint"),
    ("width", "NAXIS1", "bigint"),
    ("height", "NAXIS2", "bigint"),
    ("planes", "NAXIS3", "bigint"),
    ("bscale", "BSCALE", "double"),
    ("bzero", "BZERO", "double"),
    ("bayerpat", "BAYERPAT", "string"),
    ("object", "OBJECT", "string"),
    ("ra_deg", "OBJCTRA", "double"),
    ("ra_text", "OBJCTRA", "string"),
    ("dec_deg", "OBJCTDEC", "double"),
    ("dec_text", "OBJCTDEC", "string"),
    ("rotation_deg", "OBJCTROT", "double"),
    ("exptime_s", "EXPTIME", "double"),
    ("gain", "GAIN", "double"),
    ("offset", "OFFSET", "double"),
    ("xbinning", "XBINNING", "bigint"),
    ("ybinning", "YBINNING", "bigint"),
    ("filter", "FILTER", "string"),
    ("instrument", "INSTRUME", "string"),
    ("telescope", "TELESCOP", "string"),
    ("focal_len_mm", "FOCALLEN", "double"),
    ("focal_ratio", "FOCRATIO", "double"),
    ("date_obs", "DATE-OBS", "string"),
    ("date_loc", "DATE-LOC", "string"),
)
# Cards the typed projection reads; everything else is filtered out at the scan.
CATALOG_KEYWORDS = [keyword for _, keyword, _ in CATALOG_FIELDS]


def header_values(cards: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per frame with the first value of every catalog keyword, as text.

    The keyword list is fixed, so no job is needed to find the names; frames without any of
    the cards are absent. Repeated cards are reduced to the first, then a frame has at most one
    row per keyword. ``rows`` says about how many cards there are, so that tasks follow their
    number and a header's cards meet in one shuffle; else they are reduced on the map side. With a ``vtype`` column text fields take quoted
    values only and number fields unquoted ones: a first card of the other type gives NULL,
    whatever follows it.
    """
    typed = "vtype" in cards.columns
    wanted = cards.filter(F.col("name").isin(*CATALOG_KEYWORDS) & F.col("value").isNotNull())
    if rows is not None:
        wanted = dealt(wanted.select("frame_id", "ord", "name", "value", *["vtype"] * typed), ["frame_id"], rows)
    kind = F.col("vtype") if typed else F.lit(None).cast("string")
    first = wanted.groupBy("frame_id", "name").agg(
        F.min_by(F.struct("value", kind.alias("vtype")), "ord").alias("card")
    )
    entries = F.map_from_entries(F.collect_list(F.struct("name", "card")))
    by_name = first.groupBy("frame_id").agg(entries.alias("values"))

    def field(keyword: str, kind: str) -> Column:
        card = F.try_element_at("values", F.lit(keyword))
        fits = card["vtype"] == ("string" if kind == "string" else "number")
        return F.when(fits, card["value"]) if typed else card["value"]

    return by_name.select(
        "frame_id", *[field(keyword, kind).alias(column) for column, keyword, kind in CATALOG_FIELDS]
    )


def catalog(cards: DataFrame, rows: int | None = None) -> DataFrame:
    """Typed metadata per frame; ``rows`` as in ``header_values``. A value of the wrong type is NULL."""
    text = header_values(cards, rows)
    typed = {
        column: F.col(column).try_cast(kind)
        for column, _, kind in CATALOG_FIELDS
        if kind != "string"
    }
    rows = text.withColumns(typed)
    has_pattern = F.col("bayerpat").isNotNull()
    cube = ~has_pattern & (F.col("axes") == 3) & (F.col("planes") == 3)
    binning = F.when(
        F.col("xbinning").isNotNull() & F.col("ybinning").isNotNull(),
        F.struct(F.col("xbinning").alias("x"), F.col("ybinning").alias("y")),
    )
    return rows.select(
        "frame_id",
        "width",
        "height",
        "axes",
        "planes",
        F.when(F.coalesce(cube, F.lit(False)), 3).otherwise(1).alias("channels"),
        "bitpix",
        "bscale",
        "bzero",
        F.coalesce(
            (F.col("bitpix") == 16) & (S.default_zero(F.col("bzero")) == 32768.0), F.lit(False)
        ).alias("is_unsigned16"),
        S.stripped(F.col("bayerpat")).alias("bayerpat"),
        "object",
        "ra_deg",
        "ra_text",
        "dec_deg",
        "dec_text",
        "rotation_deg",
        "exptime_s",
        "gain",
        "offset",
        binning.alias("binning"),
        "filter",
        "instrument",
        "telescope",
        "focal_len_mm",
        "focal_ratio",
        "date_obs",
        "date_loc",
    )


def summary(frames: DataFrame) -> DataFrame:
    """Label and value rows of the curated summary, in order.

    Resolution, bit depth and channels are always there, other fields when not blank.
    """
    c = F.col
    fields = [
        ("Resolution", F.format_string("%s x %s", F.coalesce(c("width"), F.lit(0)), F.coalesce(c("height"), F.lit(0)))),
        ("Bit depth", S.bit_depth_label(c("bitpix"), c("is_unsigned16"))),
        (
            "Channels",
            F.format_string("%d (%s)", c("channels"), S.channel_label(c("channels"), c("bayerpat"))),
        ),
        ("Bayer", c("bayerpat")),
        ("Object", c("object")),
        ("RA", S.coordinate("ra", c("ra_deg"), c("ra_text"))),
        ("DEC", S.coordinate("dec", c("dec_deg"), c("dec_text"))),
        ("Rotation", F.concat(S.trim_float(c("rotation_deg")), F.lit("°"))),
        ("Exposure", F.concat(S.trim_float(c("exptime_s")), F.lit(" s"))),
        ("Gain", S.trim_float(c("gain"))),
        ("Offset", S.trim_float(c("offset"))),
        ("Binning", F.concat(c("binning.x").cast("string"), F.lit("x"), c("binning.y").cast("string"))),
        ("Filter", c("filter")),
        ("Instrument", c("instrument")),
        ("Telescope", S.telescope_label(c("telescope"), c("focal_len_mm"), c("focal_ratio"))),
        ("Date-obs", c("date_obs")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(label).alias("label"), S.non_blank(value).alias("value"))
            for i, (label, value) in enumerate(fields)
        ]
    )
    return (
        frames.select("frame_id", F.explode(rows).alias("f"))
        .select("frame_id", "f.*")
        .filter("value is not null")
    )


def acquisition_time(date_loc: Column, date_obs: Column) -> tuple[Column, Column]:
    """Epoch seconds and the text they came from: DATE-LOC if it parses, else DATE-OBS."""
    loc, obs = S.stripped(date_loc), S.stripped(date_obs)
    texts = F.struct(
        loc.alias("loc"), obs.alias("obs"), S.parse_date_obs(loc).alias("loc_time"), S.parse_date_obs(obs).alias("obs_time")
    )

    def chosen(t: Column) -> Column:
        text = F.when(t["loc_time"].isNotNull(), t["loc"]).when(t["obs_time"].isNotNull(), t["obs"])
        return F.struct(F.coalesce(t["loc_time"], t["obs_time"]).alias("time"), text.alias("time_str"))

    found = S.bound(texts, chosen)
    return found["time"].alias("time"), found["time_str"].alias("time_str")


# --- image units and cards ----------------------------------------------------------


def first_image(hdus: DataFrame) -> DataFrame:
    """The first unit holding an image, per file; files without one are absent.

    A minimum per file, so it combines on the map side and needs no sort.
    """
    rest = [c for c in hdus.columns if c not in ("path", "is_image")]
    packed = F.struct("hdu", *[c for c in rest if c != "hdu"])
    return (
        hdus.filter("is_image")
        .groupBy("path")
        .agg(F.min_by(packed, "hdu").alias("u"))
        .select("path", "u.*")
    )


def header_cards(raw: DataFrame) -> DataFrame:
    """80-column cards (``card``) to name, value, vtype, comment; strings without quotes."""
    card = F.col("card")
    name = F.rtrim(F.substring(card, 1, 8))
    valued = (F.substring(card, 9, 2) == "= ") & ~name.isin("COMMENT", "HISTORY", "")
    body = F.substring(card, 11, 70)
    quoted = F.ltrim(body).startswith("'")
    string = "^\\s*'((?:[^']|'')*)'"
    text = F.trim(F.replace(F.regexp_extract(body, string, 1), F.lit("''"), F.lit("'")))
    plain = F.trim(F.regexp_extract(body, "^([^/]*)", 1))
    tail = F.when(quoted, F.regexp_extract(body, string + "\\s*/(.*)$", 2)).otherwise(
        F.regexp_extract(body, "^[^/]*/(.*)$", 1)
    )
    commentary = F.rtrim(F.substring(card, 9, 72))
    return raw.select(
        *[c for c in raw.columns if c != "card"],
        name.alias("name"),
        F.when(valued & quoted, text).when(valued, F.nullif(plain, F.lit(""))).alias("value"),
        F.when(valued & quoted, "string")
        .when(valued & plain.isin("T", "F"), "logical")
        .when(valued & (plain != ""), "number")
        .alias("vtype"),
        F.when(valued, F.trim(tail)).otherwise(commentary).alias("comment"),
    )


# --- working set --------------------------------------------------------------------


def add_paths(working: DataFrame, new: DataFrame) -> DataFrame:
    """Append unseen paths of ``new`` (path, ord) behind ``working`` (path, ord), without gaps.

    Repeats in ``new`` count once, at their first place; ``added`` marks the new rows and
    ``first_added`` the first of them. New paths are put in order by range partitions, each
    numbered from the sizes of those before it, so no task has to number the whole set.
    """
    unseen = new.groupBy("path").agg(F.min("ord").alias("_ord")).join(
        working.select("path"), "path", "left_anti"
    )
    ordered = unseen.repartitionByRange("_ord", "path").sortWithinPartitions("_ord", "path").select(
        "path", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    ordered = staged(ordered, "unseen")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_from"))
    last = working.agg(F.max("ord")).first()[0]
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0)) + (0 if last is None else last + 1)
    # one row per shuffle partition
    placed = ordered.join(F.broadcast(parts.select("_part", "_from", start.alias("_start"))), "_part")
    first = 0 if last is None else last + 1
    placed = placed.select("path", (F.col("_start") + F.col("_at") - F.col("_from")).alias("ord"))
    return working.select("path", "ord").withColumns({"added": F.lit(False), "first_added": F.lit(False)}).unionByName(
        placed.withColumns({"added": F.lit(True), "first_added": F.col("ord") == first})
    )


# --- content hashes -----------------------------------------------------------------


def content_hash(content: Column) -> Column:
    """SHA-256 of a binary column, such as a file's bytes."""
    return F.sha2(content, 256)


def _ordered_digest(rows: DataFrame, block: Column, order: Column, text: Column, glue: str) -> DataFrame:
    """SHA-256 per frame over its rows' text in order, in two levels.

    Rows are digested per block, then the blocks' digests per frame, so that a frame with
    very many rows is spread over tasks and no list grows with it beyond its blocks.
    """

    def digest(glue: str) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda r: r["t"])
        return F.sha2(F.array_join(parts, glue), 256)

    blocks = rows.select("frame_id", block.alias("b"), order.alias("o"), text.alias("t"))
    return (
        blocks.groupBy("frame_id", "b")
        .agg(digest(glue).alias("t"))
        .withColumnRenamed("b", "o")
        .groupBy("frame_id")
        .agg(digest("").alias("sha256"))
    )


def header_hash(cards: DataFrame) -> DataFrame:
    """SHA-256 of a frame's cards as ``name=value`` lines, in blocks of 256 positions."""
    line = F.concat(F.col("name"), F.lit("="), F.coalesce("value", F.lit("")))
    return _ordered_digest(cards, F.floor(F.col("ord") / 256), F.col("ord"), line, "\n")


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every scanline's samples as they are stored in a file: typed, big-endian."""
    for batch in batches:
        lines = batch.column("samples").fill_null([])
        bounds = np.append(0, np.cumsum(np.asarray(lines.value_lengths(), np.int64)))
        values = np.asarray(lines.flatten(), np.float64)
        kinds = batch.column("sample_type").to_pylist()
        digests = [
            hashlib.sha256(values[lo:hi].astype(_ENCODED[kind]).tobytes()).hexdigest()
            for kind, lo, hi in zip(kinds, bounds.tolist(), bounds[1:].tolist())
        ]
        kept = [batch.column(c) for c in ("frame_id", "plane", "y")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.string())], ["frame_id", "plane", "y", "digest"])


def pixel_hash(scanlines: DataFrame) -> DataFrame:
    """SHA-256 over the digests of a frame's scanlines, in blocks of 1024 lines of a plane.

    A line's digest is over its samples' bytes as a file stores them, so it needs no text.
    Scanlines are hashed where they are; only digests are shuffled.
    """
    key = scanlines.schema["frame_id"].dataType.simpleString()
    digests = scanlines.select("frame_id", "plane", "y", "sample_type", "samples").mapInArrow(
        _line_digests, f"frame_id {key}, plane int, y int, digest string"
    )
    block = F.struct(F.col("plane").alias("p"), F.floor(F.col("y") / 1024).alias("y"))
    return _ordered_digest(digests, block, F.col("y"), F.col("digest"), "")
