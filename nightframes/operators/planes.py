"""Image planes: detection plane, green plane, demosaic, RGB loading, channel split.

Input is the ``scanlines`` table: one row per frame, plane and y with ``samples`` as an
array, and the frame's descriptor (``width, height, axes, planes, sample_type, bscale,
bzero, bayerpat``) on every row. Operators work on whole scanlines, a few thousand times
fewer rows than pixels, and explode to pixels as the last step of a stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.session import attach, staged

# Rows per band when neighbouring scanlines are needed; a band and its two rows of
# overlap are one group, so a tall frame is spread over many tasks.
BAND_ROWS = 256
# CFA keywords that lose their meaning once a frame is debayered.
CFA_KEYWORDS = ("BAYERPAT", "XBAYROFF", "YBAYROFF", "BAYOFFX", "BAYOFFY")

DESCRIPTOR = "width height axes planes sample_type bscale bzero bayerpat".split()


def with_shape(frames: DataFrame) -> DataFrame:
    """Add ``shape`` and ``channels`` to rows that carry the descriptor."""
    shape = S.frame_shape(F.col("axes"), F.col("planes"), F.col("bayerpat"))
    return frames.withColumn("shape", shape).withColumn("channels", S.channel_count(F.col("shape")))


def cubes(rows: DataFrame) -> DataFrame:
    return rows.filter(S.is_rgb_cube(F.col("axes"), F.col("planes"), F.col("bayerpat")))


def monos(rows: DataFrame) -> DataFrame:
    return rows.filter(S.is_mono(F.col("axes"), F.col("bayerpat")))


def mosaics(rows: DataFrame) -> DataFrame:
    return rows.filter(S.is_mosaic(F.col("axes"), F.col("bayerpat")))


def explode_samples(scanlines: DataFrame) -> DataFrame:
    """One row per pixel with x and ``raw``."""
    kept = [c for c in scanlines.columns if c != "samples"]
    return scanlines.select(*kept, F.posexplode("samples").alias("x", "raw"))


def physical_pixels(scanlines: DataFrame, plane: int | None = None) -> DataFrame:
    """Scaled pixel values; with ``plane`` only that plane is read and scaled."""
    rows = scanlines if plane is None else scanlines.filter(F.col("plane") == plane)
    value = S.physical(F.col("raw"), F.col("bscale"), F.col("bzero"))
    return explode_samples(rows).select("frame_id", "plane", "y", "x", value.alias("v"))


def green_value(
    raw: Column, sample_type: Column, bscale: Column, bzero: Column
) -> tuple[Column, Column]:
    """Value ``v`` and ``saturation`` of a cube's green sample.

    Float cubes are mapped 1.0 to 65535 with a fixed scale, so frames stay comparable.
    """
    value = S.physical(raw.cast("double"), bscale, bzero)
    is_float = sample_type.isin(*S.FLOAT_TYPES)
    v = F.when(is_float, S.round_clamped(value * 65535.0, 0.0, 65535.0)).otherwise(value)
    top = F.when(is_float, 65535.0).otherwise(S.sample_saturation(sample_type, bscale, bzero))
    return v.alias("v"), top.alias("saturation")


def green_plane(scanlines: DataFrame) -> DataFrame:
    """Pixels of the cubes' green plane."""
    rows = cubes(scanlines).filter(F.col("plane") == 1)
    columns = (F.col(c) for c in ("raw", "sample_type", "bscale", "bzero"))
    return explode_samples(rows).select("frame_id", "y", "x", *green_value(*columns))


# --- detection plane ----------------------------------------------------------------


def green_parity(cfa: Column) -> Column:
    """Parity of x + y at the two green sites of a 2x2 cell."""
    return F.when(cfa.isin("RGGB", "BGGR"), 1).otherwise(0)


def is_green_site(x: Column, y: Column, cfa: Column) -> Column:
    return (x + y) % 2 == green_parity(cfa)


def detection_rows(scanlines: DataFrame) -> DataFrame:
    """Scanlines of the plane stars are looked for on.

    Mosaics give the mean of the two green sites of each 2x2 cell, mono frames themselves,
    cubes their green plane. Other shapes are left out, see ``detection_errors``.
    Columns: frame_id, width, height, y, values, saturation, bounded. ``bounded`` says that the
    values are few because the source has a ceiling; filters on it reach the scan.
    """
    saturation = S.sample_saturation(F.col("sample_type"), F.col("bscale"), F.col("bzero"))
    scaled = F.transform("samples", lambda s: S.physical(s, F.col("bscale"), F.col("bzero")))

    bounded = S.has_ceiling(F.col("sample_type"), F.col("bscale"))

    mono = monos(scanlines).select(
        "frame_id",
        "width",
        "height",
        "y",
        scaled.alias("values"),
        saturation.alias("saturation"),
        bounded.alias("bounded"),
    )

    is_float = F.col("sample_type").isin(*S.FLOAT_TYPES)
    quantized = F.transform(scaled, lambda v: S.round_clamped(v * 65535.0, 0.0, 65535.0))
    cube = cubes(scanlines).filter(F.col("plane") == 1).select(
        "frame_id",
        "width",
        "height",
        "y",
        F.when(is_float, quantized).otherwise(scaled).alias("values"),
        F.when(is_float, 65535.0).otherwise(saturation).alias("saturation"),
        (is_float | bounded).alias("bounded"),
    )

    cfa = S.cfa_pattern(F.col("bayerpat"))
    half_w, half_h = F.floor(F.col("width") / 2).cast("int"), F.floor(F.col("height") / 2).cast("int")
    # The green site's column inside a cell, for the scanline at hand.
    site = F.pmod(green_parity(cfa) - F.col("y"), F.lit(2))
    # Every row keeps only its green sites before the two rows of a cell meet.
    greens = F.transform(
        F.sequence(F.lit(0), half_w - 1),
        lambda cx: S.physical(
            F.element_at("samples", cx * 2 + site + 1), F.col("bscale"), F.col("bzero")
        ),
    )
    mosaic = (
        mosaics(scanlines)
        .filter(cfa.isNotNull() & (half_w > 0))
        .filter(F.col("y") < half_h * 2)
        .select(
            "frame_id",
            half_w.alias("width"),
            half_h.alias("height"),
            F.floor(F.col("y") / 2).cast("int").alias("cy"),
            (F.col("y") % 2).alias("odd"),
            greens.alias("greens"),
            saturation.alias("saturation"),
            bounded.alias("bounded"),
        )
        .groupBy("frame_id", F.col("cy").alias("y"), "bounded")
        .agg(
            F.first("width").alias("width"),
            F.first("height").alias("height"),
            F.first("saturation").alias("saturation"),
            F.first(F.when(F.col("odd") == 0, F.col("greens")), ignorenulls=True).alias("even"),
            F.first(F.when(F.col("odd") == 1, F.col("greens")), ignorenulls=True).alias("odd"),
        )
        .select(
            "frame_id",
            "width",
            "height",
            "y",
            F.zip_with("even", "odd", lambda a, b: (a + b) / 2).alias("values"),
            "saturation",
            "bounded",
        )
    )
    return mono.unionByName(cube).unionByName(mosaic)


def detection_pixels(scanlines: DataFrame) -> DataFrame:
    return detection_rows(scanlines).select(
        "frame_id", "y", F.posexplode("values").alias("x", "v"), "saturation"
    )


def detection_errors(frames: DataFrame) -> DataFrame:
    """Frames no detection plane can be built for, with the reason."""
    rows = with_shape(frames)
    bad_pattern = (F.col("shape") == "mosaic") & S.cfa_pattern(F.col("bayerpat")).isNull()
    message = (
        F.when(bad_pattern, F.concat(F.lit("no mosaic layout is called "), F.col("bayerpat")))
        .when(
            F.col("shape") == "other",
            F.concat(
                F.lit("no single plane to look for stars on: "),
                F.col("axes").cast("string"),
                F.lit(" axes"),
            ),
        )
    )
    return rows.select("frame_id", message.alias("error")).filter("error is not null")


# --- demosaic -----------------------------------------------------------------------


def with_neighbours(scanlines: DataFrame, height: Column) -> DataFrame:
    """Add the scanlines above and below, mirrored at the frame's edges.

    Rows are grouped by band, each band also gets the row before and after it. One
    shuffle, and no group larger than a band.
    """
    y = F.col("y")
    bands = F.array_distinct(
        F.array(*[F.floor((y + d) / BAND_ROWS) for d in (-1, 0, 1)])
    )
    w = Window.partitionBy("frame_id", "plane", "band").orderBy("y")
    above, below = F.lag("samples").over(w), F.lead("samples").over(w)
    return (
        scanlines.withColumn("band", F.explode(bands))
        .withColumn("above", above)
        .withColumn("below", below)
        .filter(F.col("band") == F.floor(y / BAND_ROWS))
        .drop("band")
        .withColumn("_above", F.coalesce("above", "below", "samples"))
        .withColumn(
            "below", F.when(y == height - 1, F.col("_above")).otherwise(F.col("below"))
        )
        .withColumn("above", F.col("_above"))
        .drop("_above")
    )


def _sample_16(value: Column, sample_type: Column, bscale: Column, bzero: Column) -> Column:
    """U8 samples as they are, everything else scaled and rounded to 16 bits."""
    scaled = S.round_to_u16(S.physical(value, bscale, bzero))
    return F.when(sample_type == "U8", value.cast("int")).otherwise(scaled)


def demosaic(scanlines: DataFrame, pattern: str | None = None) -> DataFrame:
    """RGB pixels of mosaics by 3x3 linear interpolation.

    Columns: frame_id, width, height, y, x, r, g, b, depth. Edges are mirrored and means
    truncated. Frames without a known pattern are left out, see ``rgb_errors``.
    """
    cfa = S.cfa_pattern(F.col("bayerpat"), S.check_pattern(pattern))
    rows = scanlines.filter((F.col("axes") == 2) & cfa.isNotNull()).withColumn("cfa", cfa)
    ints = F.transform(
        "samples",
        lambda s: _sample_16(s, F.col("sample_type"), F.col("bscale"), F.col("bzero")),
    )
    rows = with_neighbours(
        rows.select(
            "frame_id",
            "plane",
            "y",
            "width",
            "height",
            "cfa",
            F.when(F.col("sample_type") == "U8", 8).otherwise(16).alias("depth"),
            ints.alias("samples"),
        ),
        F.col("height"),
    )
    x, w = F.col("x"), F.col("width")
    left = F.when(x == 0, F.least(F.lit(1), w - 1)).otherwise(x - 1) + 1
    right = F.when(x == w - 1, F.greatest(w - 2, F.lit(0))).otherwise(x + 1) + 1

    def at(row: str, index: Column) -> Column:
        return F.element_at(F.col(row), index)

    pixels = rows.select("*", F.posexplode("samples").alias("x", "own"))
    own = F.col("own")
    across = F.floor((at("samples", left) + at("samples", right)) / 2)
    along = F.floor((at("above", x + 1) + at("below", x + 1)) / 2)
    cross = F.floor(
        (at("samples", left) + at("samples", right) + at("above", x + 1) + at("below", x + 1)) / 4
    )
    corners = F.floor(
        (at("above", left) + at("above", right) + at("below", left) + at("below", right)) / 4
    )
    # Column and row parity of the red site; blue sits diagonally opposite.
    red_x = F.when(F.col("cfa").isin("RGGB", "GBRG"), 0).otherwise(1)
    red_y = F.when(F.col("cfa").isin("RGGB", "GRBG"), 0).otherwise(1)
    in_red_column = x % 2 == red_x
    in_red_row = F.col("y") % 2 == red_y

    red = (
        F.when(in_red_row & in_red_column, own)
        .when(in_red_row, across)
        .when(in_red_column, along)
        .otherwise(corners)
    )
    green = F.when(in_red_row == in_red_column, cross).otherwise(own)
    blue = (
        F.when(~in_red_row & ~in_red_column, own)
        .when(~in_red_row, across)
        .when(~in_red_column, along)
        .otherwise(corners)
    )
    return pixels.select(
        "frame_id",
        "width",
        "height",
        "y",
        "x",
        red.cast("int").alias("r"),
        green.cast("int").alias("g"),
        blue.cast("int").alias("b"),
        "depth",
    )


# --- RGB loading --------------------------------------------------------------------

RGB_COLUMNS = "frame_id width height y x r g b depth".split()


def float_ceilings(scanlines: DataFrame) -> DataFrame:
    """Largest finite physical value per float frame, at least zero (a staged table)."""
    scaled = F.transform("samples", lambda s: S.physical(s, F.col("bscale"), F.col("bzero")))
    finite = F.filter(scaled, lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return staged(
        scanlines.filter(F.col("sample_type").isin(*S.FLOAT_TYPES))
        .groupBy("frame_id")
        .agg(F.greatest(F.max(F.array_max(finite)), F.lit(0.0)).alias("ceiling")),
        "ceilings",
    )


def scale_to_u16(value: Column, sample_type: Column, ceiling: Column) -> Column:
    """Physical value to 16 bits: floats relative to the frame's maximum, others rounded."""
    relative = F.when(ceiling > 0, F.greatest(value, F.lit(0.0)) * (65535.0 / ceiling)).otherwise(0.0)
    return S.round_to_u16(F.when(sample_type.isin(*S.FLOAT_TYPES), relative).otherwise(value))


def _with_ceiling(rows: DataFrame, ceilings: DataFrame | None) -> DataFrame:
    known = float_ceilings(rows) if ceilings is None else ceilings
    return attach(rows, known, ["frame_id"], F.col("y"), "left")


def _display_sample(raw: Column) -> Column:
    scaled = scale_to_u16(
        S.physical(raw, F.col("bscale"), F.col("bzero")), F.col("sample_type"), F.col("ceiling")
    )
    return F.when(F.col("sample_type") == "U8", raw.cast("int")).otherwise(scaled)


def _depth() -> Column:
    return F.when(F.col("sample_type") == "U8", 8).otherwise(16)


def plane_triples(scanlines: DataFrame) -> DataFrame:
    """Bring the three planes of a cube's scanline together as arrays r, g, b."""
    kept = [c for c in scanlines.columns if c not in ("plane", "samples", "frame_id", "y")]
    return scanlines.groupBy("frame_id", "y").agg(
        *[F.first(c).alias(c) for c in kept],
        *[
            F.first(F.when(F.col("plane") == i, F.col("samples")), ignorenulls=True).alias(c)
            for i, c in enumerate("rgb")
        ],
    )


def interleave(scanlines: DataFrame) -> DataFrame:
    """Cubes as pixels with the three raw samples side by side."""
    rows = plane_triples(scanlines).select(
        "frame_id", "y", F.posexplode("r").alias("x", "r"), "g", "b"
    )
    at = F.col("x") + 1
    return rows.select(
        "frame_id", "y", "x", "r", F.element_at("g", at).alias("g"), F.element_at("b", at).alias("b")
    )


def deinterleave(rgb: DataFrame) -> DataFrame:
    """RGB pixels as one row per plane; the inverse of ``interleave``."""
    kept = [c for c in rgb.columns if c not in "rgb"]
    planes = F.array(
        *[F.struct(F.lit(i).alias("plane"), F.col(c).alias("v")) for i, c in enumerate("rgb")]
    )
    return rgb.select(*kept, F.explode(planes).alias("p")).select(*kept, "p.plane", "p.v")


def rgb_from_cube(scanlines: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    rows = plane_triples(_with_ceiling(scanlines, ceilings))
    pixels = rows.select("*", F.posexplode("r").alias("x", "own"))
    at = F.col("x") + 1
    return pixels.select(
        "frame_id",
        "width",
        "height",
        "y",
        "x",
        _display_sample(F.col("own")).alias("r"),
        _display_sample(F.element_at("g", at)).alias("g"),
        _display_sample(F.element_at("b", at)).alias("b"),
        _depth().alias("depth"),
    )


def rgb_from_mono(scanlines: DataFrame, ceilings: DataFrame | None = None) -> DataFrame:
    """Single-plane frames with the sample in all three channels."""
    rows = explode_samples(_with_ceiling(scanlines, ceilings))
    pixels = rows.withColumn("s", _display_sample(F.col("raw")))
    return pixels.select(
        "frame_id",
        "width",
        "height",
        "y",
        "x",
        *[F.col("s").alias(c) for c in "rgb"],
        _depth().alias("depth"),
    )


def load_mono_raw(scanlines: DataFrame) -> DataFrame:
    """Two-axis frames as grey, mosaics included, without interpolation."""
    return rgb_from_mono(scanlines.filter(F.col("axes") == 2))


def load_rgb(scanlines: DataFrame, pattern: str | None = None, force: bool = False) -> DataFrame:
    """Any loadable frame as RGB pixels with a ``notice`` saying how.

    Cubes are interleaved and mono frames replicated, unless ``force`` asks for every
    frame to be demosaiced. An explicit pattern alone does not demosaic a mono frame.
    """
    if force:
        return demosaic(scanlines, pattern).withColumn("notice", F.lit("Demosaiced"))
    ceilings = float_ceilings(cubes(scanlines).unionByName(monos(scanlines)))
    parts = [
        (rgb_from_cube(cubes(scanlines), ceilings), "AlreadyDebayeredRgbCube"),
        (rgb_from_mono(monos(scanlines), ceilings), "AlreadyDebayeredMono"),
        (demosaic(mosaics(scanlines), pattern), "Demosaiced"),
    ]
    tagged = [df.select(RGB_COLUMNS).withColumn("notice", F.lit(n)) for df, n in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def rgb_errors(frames: DataFrame, pattern: str | None = None, force: bool = False) -> DataFrame:
    """Frames ``load_rgb`` cannot load, with the reason."""
    rows = with_shape(frames)
    needs_pattern = F.col("shape").isin("mosaic", "other")
    if force:
        needs_pattern = F.lit(True)
    no_pattern = S.cfa_pattern(F.col("bayerpat"), S.check_pattern(pattern)).isNull()
    message = F.when(
        needs_pattern & (F.col("axes") != 2),
        F.concat(F.lit("a mosaic has 2 axes, this frame has "), F.col("axes").cast("string")),
    ).when(needs_pattern & no_pattern, "the mosaic layout is not known")
    return rows.select("frame_id", message.alias("error")).filter("error is not null")


def split_channels(
    scanlines: DataFrame, pattern: str | None = None, force: bool = False
) -> DataFrame:
    """Physical values per channel: frame_id, y, x, channel, v.

    Mosaics (or every frame with ``force``) are demosaiced, cubes split by plane. Mono
    frames are an error here, see ``split_errors``.
    """
    wanted = scanlines if force else mosaics(scanlines)
    names = F.array(F.lit("r"), F.lit("g"), F.lit("b"))
    out = deinterleave(demosaic(wanted, pattern).select("frame_id", "y", "x", "r", "g", "b"))
    out = out.withColumn("v", F.col("v").cast("double"))
    if not force:
        out = out.unionByName(physical_pixels(cubes(scanlines)))
    return out.select(
        "frame_id", "y", "x", F.element_at(names, F.col("plane") + 1).alias("channel"), "v"
    )


def split_errors(frames: DataFrame, pattern: str | None = None, force: bool = False) -> DataFrame:
    demosaiced = F.lit(True) if force else F.col("bayerpat").isNotNull()
    no_pattern = S.cfa_pattern(F.col("bayerpat"), S.check_pattern(pattern)).isNull()
    message = (
        F.when(
            demosaiced & (F.col("axes") != 2),
            F.concat(
                F.lit("a mosaic has 2 axes, this frame has "),
                F.col("axes").cast("string"),
            ),
        )
        .when(demosaiced & no_pattern, "the mosaic layout is not known")
        .when(
            ~demosaiced & ~((F.col("axes") == 3) & (F.col("planes") == 3)),
            "neither a mosaic layout nor three planes to split",
        )
    )
    return frames.select("frame_id", message.alias("error")).filter("error is not null")


def debayer(
    scanlines: DataFrame, frames: DataFrame, pattern: str | None = None, force: bool = False
) -> DataFrame:
    """RGB pixels together with the source's sample type and scaling, for write-back."""
    source = staged(frames.select("frame_id", "sample_type", "bscale", "bzero"), "source")
    return attach(load_rgb(scanlines, pattern, force), source, ["frame_id"], F.col("y"))


def encode_rgb_as_source(debayered: DataFrame) -> DataFrame:
    """Debayered pixels as planar raw samples of the source's type.

    8-bit sources were handled as raw samples and are stored unchanged.
    """
    encoded = S.encode_as_source(
        F.col("v").cast("double"), F.col("sample_type"), F.col("bscale"), F.col("bzero")
    )
    raw = F.when(F.col("depth") == 8, F.col("v").cast("double")).otherwise(encoded)
    return deinterleave(debayered).select("frame_id", "plane", "y", "x", raw.alias("raw"))


def to_scanlines(pixels: DataFrame, value: str = "raw") -> DataFrame:
    """Pixels back to one row per frame, plane and y with samples in x order."""
    return pixels.groupBy("frame_id", "plane", "y").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("x", F.col(value).alias("s")))), lambda p: p["s"]
        ).alias("samples")
    )
