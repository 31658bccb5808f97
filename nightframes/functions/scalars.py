"""Column expressions: number and coordinate text, dates, sample scaling and encoding.

Every function takes and returns Columns, so the work stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The supported sample types and their raw ranges.
INTEGER_RANGES = {
    "U8": (0.0, 255.0),
    "I16": (-32768.0, 32767.0),
    "I32": (-2147483648.0, 2147483647.0),
    "I64": (-9223372036854775808.0, 9223372036854775807.0),
}
FLOAT_TYPES = ("F32", "F64")
# FITS BITPIX codes and the sample type each stands for.
BITPIX_TYPES = {8: "U8", 16: "I16", 32: "I32", 64: "I64", -32: "F32", -64: "F64"}
CFA_PATTERNS = ("RGGB", "GBRG", "BGGR", "GRBG")

_BLANKS = "^\\s+|\\s+$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` computed once, where every use of it would compute it anew."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.regexp_replace(text, _BLANKS, "")


def non_blank(text: Column) -> Column:
    """The stripped text, NULL when nothing is left."""
    return F.nullif(stripped(text), F.lit(""))


# --- rounding -----------------------------------------------------------------------


def half_away(v: Column) -> Column:
    """Round to a whole number, halves away from zero.

    ``F.round`` goes through BigDecimal for every value; splitting off the fraction is
    exact for doubles and stays in primitive arithmetic.
    """
    a = F.abs(v)
    whole = F.floor(a).cast("double")
    # Adding zero turns -0.0 into 0.0.
    return F.signum(v) * (whole + F.when(a - whole >= 0.5, 1.0).otherwise(0.0)) + 0.0


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def round_clamped(v: Column, lo: float, hi: float) -> Column:
    """Round halves away from zero into [lo, hi]; NaN counts as zero."""
    return half_away(clamp(F.nanvl(v, F.lit(0.0)), lo, hi))


def round_to_u16(v: Column) -> Column:
    return round_clamped(v, 0.0, 65535.0).cast("int")


def round_to(v: Column, places: int) -> Column:
    return F.round(v, places)


# --- number text --------------------------------------------------------------------


def trim_float(v: Column) -> Column:
    """Whole numbers without a fraction, others with up to six decimals."""
    whole = (v == F.floor(v).cast("double")) & (F.abs(v) < 1e15)
    text = F.regexp_replace(F.format_string("%.6f", v), "\\.?0+$", "")
    return F.when(whole, v.cast("bigint").cast("string")).when(v.isNotNull(), text)


def format_stat(v: Column) -> Column:
    """Whole numbers without a fraction, others to three decimals."""
    return F.when(v == F.rint(v), F.format_string("%.0f", v)).when(
        v.isNotNull(), F.format_string("%.3f", v)
    )


def format_star(v: Column) -> Column:
    return F.when(v.isNotNull(), F.format_string("%.2f", v))


def shortest_float(v: Column) -> Column:
    """Shortest decimal text that reads back as ``v``, never in exponent form; inf, -inf, NaN by name."""
    a = F.abs(v)
    brief = F.format_string("%.15e", a)  # where 16 digits do, the plain cast may give 17
    # the smallest numbers have fewer digits than the cast writes
    tiny = F.coalesce(*[F.when(t.cast("double") == a, t) for t in (F.format_string(f"%.{n}e", a) for n in range(16))])
    text = F.when(a < 2.3e-308, tiny).when(brief.cast("double") == a, brief).otherwise(a.cast("string"))
    parts = [F.regexp_extract(text, r"^(\d+)(?:\.(\d*))?(?:[eE]\+?(-?\d+))?$", i) for i in (1, 2, 3)]
    whole, fraction = parts[0], F.regexp_replace(parts[1], "0+$", "")
    digits = F.concat(whole, fraction)
    point = F.length(whole) + F.coalesce(F.nullif(parts[2], F.lit("")).cast("int"), F.lit(0))
    size = F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    named = F.when(F.isnan(v), "NaN").when(a == float("inf"), "inf").when(v == 0, "0").otherwise(plain)
    return F.concat(F.when((v < 0) & ~F.isnan(v), "-").otherwise(""), named)


# --- coordinates --------------------------------------------------------------------


def to_sexagesimal(value: Column) -> Column:
    """Struct (whole, minutes, seconds) of a non-negative decimal value.

    The total is rounded to a hundredth of a second first, so 59.999 seconds carry over.
    """
    total = half_away(value * 3600.0 * 100.0) / 100.0
    whole = F.floor(total / 3600.0)
    rest = total - whole * 3600.0
    minutes = F.floor(rest / 60.0)
    return F.struct(
        whole.cast("bigint").alias("whole"),
        minutes.cast("bigint").alias("minutes"),
        (rest - minutes * 60.0).alias("seconds"),
    )


def format_coordinate(axis: str, deg: Column) -> Column:
    """RA in hours or DEC in degrees as sexagesimal text with the decimal value behind."""
    value = deg / 15.0 if axis == "ra" else deg
    parts = to_sexagesimal(F.abs(value))
    pattern = "%s%dh %02dm %05.2fs (%sh)" if axis == "ra" else "%s%d° %02d' %05.2f\" (%s°)"
    text = F.format_string(
        pattern,
        F.when(value < 0, "-").otherwise(""),
        parts["whole"],
        parts["minutes"],
        parts["seconds"],
        trim_float(value),
    )
    return F.when(deg.isNotNull(), text)


def coordinate(axis: str, deg: Column, text: Column) -> Column:
    """The formatted coordinate when there is a number, else the header's text."""
    return F.coalesce(format_coordinate(axis, deg), non_blank(text))


# --- dates --------------------------------------------------------------------------

# Fixed pattern: YYYY-MM-DDTHH:MM:SS with an optional fraction, signs as number text allows.
_STAMP = (
    "^([+-]?\\d{1,6})-\\+?(\\d{1,9})-\\+?(\\d{1,9})T\\+?(\\d{1,9}):\\+?(\\d{1,9}):"
    "([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)$"
)


def parse_date_obs(text: Column) -> Column:
    """Seconds since 1970 of a header time stamp, NULL when it is not one.

    Days run from 1 to 31 whatever the month, so "02-31" is three days after the 28th;
    second 60 is allowed for leap seconds. Years of more than six digits give NULL.
    """
    s = F.regexp_replace(stripped(text), "Z+$", "")

    def fields(s: Column) -> Column:
        found = F.split(F.regexp_replace(s, _STAMP, "$1,$2,$3,$4,$5,$6"), ",")
        return F.when(s.rlike(_STAMP) & ~s.startswith("-"), found)

    def seconds(part: Column) -> Column:
        year, month, day, hour, minute = (F.get(part, F.lit(i)).try_cast("int") for i in range(5))
        second = F.get(part, F.lit(5)).try_cast("double")
        valid = (
            month.between(1, 12)
            & day.between(1, 31)
            & (hour < 24)
            & (minute < 60)
            & (second >= 0.0)
            & (second < 61.0)
        )
        first_of_month = F.when(valid, F.make_date(year, month, F.lit(1)))
        days = F.unix_date(first_of_month) + day - 1
        return days * 86400.0 + hour * 3600.0 + minute * 60.0 + second

    return bound(bound(s, fields), seconds)


def _day_of(epoch: Column) -> Column:
    return F.floor(F.floor(epoch) / 86400)


def _second_of_day(epoch: Column) -> Column:
    return F.pmod(F.floor(epoch), F.lit(86400))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("bigint").cast("string"), 2, "0")


def format_date(epoch: Column) -> Column:
    """YYYY-MM-DD of epoch seconds, independent of the session time zone."""
    return F.date_from_unix_date(_day_of(epoch).cast("int")).cast("string")


def format_time(epoch: Column) -> Column:
    """HH:MM of epoch seconds."""
    s = _second_of_day(epoch)
    return F.concat(_two(F.floor(s / 3600)), F.lit(":"), _two(F.floor(s % 3600 / 60)))


def format_stamp(epoch: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS of epoch seconds."""
    return F.concat(
        format_date(epoch),
        F.lit(" "),
        format_time(epoch),
        F.lit(":"),
        _two(_second_of_day(epoch) % 60),
    )


# --- frame shape --------------------------------------------------------------------


def is_rgb_cube(axes: Column, planes: Column, bayerpat: Column) -> Column:
    """Plain comparisons, like the next two, so that scans can skip row groups by them."""
    return bayerpat.isNull() & (axes == 3) & (planes == 3)


def is_mono(axes: Column, bayerpat: Column) -> Column:
    return bayerpat.isNull() & (axes == 2)


def is_mosaic(axes: Column, bayerpat: Column) -> Column:
    return bayerpat.isNotNull() & (axes == 2)


def frame_shape(axes: Column, planes: Column, bayerpat: Column) -> Column:
    """rgb_cube, mono, mosaic or other."""
    return (
        F.when(is_rgb_cube(axes, planes, bayerpat), "rgb_cube")
        .when(is_mono(axes, bayerpat), "mono")
        .when(is_mosaic(axes, bayerpat), "mosaic")
        .otherwise("other")
    )


def channel_count(shape: Column) -> Column:
    return F.when(shape == "rgb_cube", 3).otherwise(1)


def bit_depth_label(bitpix: Column, unsigned16: Column) -> Column:
    return (
        F.when((bitpix == 16) & unsigned16, "16-bit unsigned integer")
        .when(bitpix == 8, "8-bit unsigned integer")
        .when(bitpix == 16, "16-bit integer")
        .when(bitpix == 32, "32-bit integer")
        .when(bitpix == 64, "64-bit integer")
        .when(bitpix == -32, "32-bit float")
        .when(bitpix == -64, "64-bit float")
        .otherwise(F.concat(F.lit("BITPIX "), bitpix.cast("string")))
    )


def channel_label(channels: Column, bayerpat: Column) -> Column:
    return (
        F.when(channels == 3, "debayered RGB")
        .when(bayerpat.isNotNull(), "mosaic")
        .otherwise("monochrome (debayered)")
    )


def telescope_label(name: Column, focal_mm: Column, ratio: Column) -> Column:
    """Name with the optics in parentheses, either one alone, or NULL."""
    name = non_blank(name)
    optics = F.nullif(
        F.concat_ws(
            " ",
            F.concat(trim_float(focal_mm), F.lit("mm")),
            F.concat(F.lit("F/"), trim_float(ratio)),
        ),
        F.lit(""),
    )
    both = F.concat(name, F.lit(" ("), optics, F.lit(")"))
    return F.coalesce(both, name, optics)


def cfa_pattern(bayerpat: Column, override: str | None = None) -> Column:
    """The colour-filter pattern: the explicit one, else the header's; NULL if unknown."""
    text = F.lit(override) if override else F.upper(stripped(bayerpat))
    return F.when(text.isin(*CFA_PATTERNS), text)


# --- sample scaling and encoding ----------------------------------------------------


def physical(raw: Column, bscale: Column, bzero: Column) -> Column:
    return bzero + bscale * raw


def default_scale(bscale: Column) -> Column:
    return F.coalesce(bscale, F.lit(1.0))


def default_zero(bzero: Column) -> Column:
    return F.coalesce(bzero, F.lit(0.0))


def has_ceiling(sample_type: Column, bscale: Column) -> Column:
    """Whether the largest raw sample is a level worth calling saturated."""
    return sample_type.isin("U8", "I16") & (bscale > 0)


def sample_saturation(sample_type: Column, bscale: Column, bzero: Column) -> Column:
    """Physical value of the largest raw sample; Infinity where there is no ceiling."""
    top = F.when(sample_type == "U8", 255.0).otherwise(32767.0)
    return F.when(has_ceiling(sample_type, bscale), bzero + bscale * top).otherwise(
        F.lit(float("inf"))
    )


def high_byte(sample: Column) -> Column:
    return F.shiftright(sample.cast("int"), 8)


def to_output_depth(sample: Column, depth: Column, bpp: int) -> Column:
    """Bring an 8- or 16-bit sample to ``bpp`` bits; 0 and the top value stay at the ends."""
    if bpp not in (8, 16, 32):
        raise ValueError("bits per pixel: 8, 16 or 32")
    wide = sample.cast("bigint")
    from8 = {8: wide, 16: wide * 257, 32: wide * 16843009}[bpp]
    from16 = {8: F.shiftright(wide, 8), 16: wide, 32: wide * 65537}[bpp]
    return F.when(depth == 8, from8).otherwise(from16)


def encode_as_source(value: Column, sample_type: Column, bscale: Column, bzero: Column) -> Column:
    """Raw sample of the source type for a physical value; whole and clamped for integers."""
    raw = (value - bzero) / bscale
    out = F.when(sample_type == "F32", raw.cast("float").cast("double"))
    for name, (lo, hi) in INTEGER_RANGES.items():
        out = out.when(sample_type == name, round_clamped(raw, lo, hi))
    return out.otherwise(raw)


# Storage of one split-off channel: top of the range and BZERO.
CHANNEL_FORMATS = {"i8": (255.0, 0.0), "i16": (65535.0, 32768.0), "i32": (4294967295.0, 2147483648.0)}


def encode_channel(value: Column, fmt: str) -> tuple[Column, float]:
    """Raw value of one channel in ``fmt`` and the BZERO that goes with it."""
    if fmt in CHANNEL_FORMATS:
        top, bzero = CHANNEL_FORMATS[fmt]
        return round_clamped(value, 0.0, top) - bzero, bzero
    if fmt == "f32":
        return value.cast("float").cast("double"), 0.0
    if fmt == "f64":
        return value, 0.0
    raise ValueError("sample formats are i8, i16, i32, f32 and f64")


def export_sample(value16: Column, target: str) -> tuple[Column, float]:
    """A 16-bit value stored as 8-bit, unsigned-16 or float samples, with its BZERO."""
    if target == "i8":
        return high_byte(value16).cast("double"), 0.0
    if target == "i16":
        return value16.cast("double") - 32768.0, 32768.0
    if target == "f32":
        return value16.cast("double"), 0.0
    raise ValueError("export formats are i8, i16 and f32")


# --- checked parameters -------------------------------------------------------------


def check_brightness(value: float) -> float:
    if not 0.0 < float(value) < 1.0:
        raise ValueError("brightness lies between 0 and 1, both excluded")
    return float(value)


def check_bpp(value: int) -> int:
    if int(value) not in (8, 16, 32):
        raise ValueError("bits per pixel: 8, 16 or 32")
    return int(value)


def check_pattern(pattern: str | None) -> str | None:
    if pattern is None:
        return None
    if pattern.strip().upper() not in CFA_PATTERNS:
        raise ValueError(f"unknown CFA pattern {pattern!r}")
    return pattern.strip().upper()
