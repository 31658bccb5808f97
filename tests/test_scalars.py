from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from nightframes.functions import scalars as S


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("1970-01-01T00:00:00", 0.0),
        ("2000-01-01T12:00:00", 946728000.0),
        ("1970-01-01T00:00:00.25", 0.25),
        (" 1970-01-02T00:00:00Z ", 86400.0),
        ("2026-05-31T04:57:09.004664", 1780203429.004664),
        ("2023-02-31T00:00:00", 1677801600.0),
        ("1969-12-31T23:59:60", 0.0),
        ("", None),
        ("2026-05-31", None),
        ("2026-05-31 04:57:09", None),
        ("2026-13-01T00:00:00", None),
        ("2026-05-32T00:00:00", None),
        ("2026-05-00T00:00:00", None),
        ("2026-05-31T24:00:00", None),
        ("2026-05-31T00:60:00", None),
        ("2026-05-31T00:00:61", None),
        ("2026-05-31T00:00", None),
        ("2026-05-31T00:00:00:00", None),
        ("2026-05-31-01T00:00:00", None),
        ("not-a-date-at-allT00:00", None),
        ("-2026-05-31T00:00:00", None),
        ("2026-99999999999-31T00:00:00", None),
    ],
)
def test_parse_date(value, text, seconds):
    assert value(S.parse_date_obs(F.lit(text))) == seconds


def test_epoch_text_ignores_the_session_zone(spark, value):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    try:
        t = F.lit(1780203429.004664)
        assert value(S.format_time(t)) == "04:57"
        assert value(S.format_date(t)) == "2026-05-31"
        assert value(S.format_stamp(t)) == "2026-05-31 04:57:09"
        assert value(S.format_stamp(F.lit(-1.0))) == "1969-12-31 23:59:59"
        assert value(S.parse_date_obs(F.lit("1970-01-01T00:00:00"))) == 0.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "v, text",
    [(180.0, "180"), (312.866739069469, "312.866739"), (30.5, "30.5"), (-0.25, "-0.25"), (None, None)],
)
def test_trim_float(value, v, text):
    assert value(S.trim_float(F.lit(v).cast("double"))) == text


@pytest.mark.parametrize(
    "v, text",
    [
        (100.0, "100"),
        (7.5, "7.5"),
        (1780203429.004664, "1780203429.004664"),
        (0.1, "0.1"),
        (1e-9, "0.000000001"),
        (12345678901234.5, "12345678901234.5"),
        (1e21, "1000000000000000000000"),
        (-3.25, "-3.25"),
        (0.0, "0"),
        (1e39, "1" + "0" * 39),
        (1e-31, "0." + "0" * 30 + "1"),
        (5e-324, "0." + "0" * 323 + "5"),
        (0.1 + 0.2, "0.30000000000000004"),
        (float("inf"), "inf"),
        (float("-inf"), "-inf"),
        (float("nan"), "NaN"),
    ],
)
def test_shortest_float(value, v, text):
    assert value(S.shortest_float(F.lit(v))) == text


@pytest.mark.parametrize(
    "axis, deg, text",
    [
        ("ra", 307.5, "20h 30m 00.00s (20.5h)"),
        ("ra", 0.0, "0h 00m 00.00s (0h)"),
        ("dec", 12.5, "12° 30' 00.00\" (12.5°)"),
        ("dec", -12.5, "-12° 30' 00.00\" (-12.5°)"),
    ],
)
def test_coordinates(value, axis, deg, text):
    assert value(S.format_coordinate(axis, F.lit(deg))) == text


def test_sexagesimal_carries(value):
    assert tuple(value(S.to_sexagesimal(F.lit(0.9999999)))) == (1, 0, 0.0)


@pytest.mark.parametrize(
    "v, rounded",
    [(0.5, 1.0), (-0.5, -1.0), (2.5, 3.0), (-2.5, -3.0), (0.49999999999999994, 0.0), (-0.2, 0.0), (4503599627370497.5, 4503599627370498.0)],
)
def test_half_away(value, v, rounded):
    assert repr(value(S.half_away(F.lit(v)))) == repr(rounded)


@pytest.mark.parametrize("v, u16", [(-3.0, 0), (65535.4, 65535), (70000.0, 65535), (1.5, 2), (float("nan"), 0)])
def test_round_to_u16(value, v, u16):
    assert value(S.round_to_u16(F.lit(v))) == u16


@pytest.mark.parametrize(
    "kind, scale, zero, top",
    [
        ("U8", 1.0, 0.0, 255.0),
        ("I16", 1.0, 32768.0, 65535.0),
        ("I16", 1.0, 0.0, 32767.0),
        ("I16", -1.0, 0.0, float("inf")),
        ("F32", 1.0, 0.0, float("inf")),
        ("I32", 1.0, 0.0, float("inf")),
    ],
)
def test_saturation(value, kind, scale, zero, top):
    assert value(S.sample_saturation(F.lit(kind), F.lit(scale), F.lit(zero))) == top


@pytest.mark.parametrize(
    "name, focal, ratio, label",
    [
        ("My Scope", 203.0, 4.5, "My Scope (203mm F/4.5)"),
        ("My Scope", None, None, "My Scope"),
        ("  ", 203.0, None, "203mm"),
        (None, None, 4.5, "F/4.5"),
        (None, None, None, None),
    ],
)
def test_telescope_label(value, name, focal, ratio, label):
    column = S.telescope_label(F.lit(name).cast("string"), F.lit(focal).cast("double"), F.lit(ratio).cast("double"))
    assert value(column) == label


def test_promotion_keeps_the_ends(value):
    for top, depth, bpp, out in ((255, 8, 16, 65535), (255, 8, 32, 4294967295), (65535, 16, 32, 4294967295), (65535, 16, 8, 255)):
        assert value(S.to_output_depth(F.lit(top), F.lit(depth), bpp)) == out
        assert value(S.to_output_depth(F.lit(0), F.lit(depth), bpp)) == 0


def test_wide_integers_are_clamped(value):
    encoded = S.encode_as_source(F.lit(1e30), F.lit("I64"), F.lit(1.0), F.lit(0.0))
    assert value(encoded) == 9223372036854775807.0


@pytest.mark.parametrize("bad", [0, 1, -0.1, 1.5])
def test_brightness_is_checked(bad):
    with pytest.raises(ValueError):
        S.check_brightness(bad)


def test_other_parameters_are_checked():
    assert S.check_bpp(16) == 16
    assert S.check_pattern(" rggb ") == "RGGB"
    for call in (lambda: S.check_bpp(12), lambda: S.check_pattern("XYZ"), lambda: S.encode_channel(F.lit(1.0), "i64")):
        with pytest.raises(ValueError):
            call()
