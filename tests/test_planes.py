from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframes.operators import planes as P
from nightframes.operators import resample as R
from nightframes.operators import stretch as T

POWERS = [[1, 2, 4, 8], [16, 32, 64, 128], [256, 512, 1024, 2048], [4096, 8192, 16384, 32767]]
RED = {"RGGB": (0, 0), "GRBG": (1, 0), "GBRG": (0, 1), "BGGR": (1, 1)}


def plane_values(df):
    return [v for row in df.orderBy("y").collect() for v in row["values"]]


@pytest.mark.parametrize(
    "pattern, values",
    [
        ("RGGB", [9.0, 36.0, 2304.0, 9216.0]),
        ("BGGR", [9.0, 36.0, 2304.0, 9216.0]),
        ("GRBG", [16.5, 66.0, 4224.0, 16895.5]),
        (" gbrg ", [16.5, 66.0, 4224.0, 16895.5]),
    ],
)
def test_detection_plane_of_a_mosaic(frame, pattern, values):
    rows = P.detection_rows(frame(POWERS, bayerpat=pattern))
    assert plane_values(rows) == values
    assert {(r["width"], r["height"], r["saturation"]) for r in rows.collect()} == {(2, 2, 32767.0)}


def test_detection_plane_drops_odd_edges(frame):
    odd = [row + [7] for row in POWERS] + [[9, 9, 9, 9, 9]]
    assert plane_values(P.detection_rows(frame(odd, bayerpat="RGGB"))) == [9.0, 36.0, 2304.0, 9216.0]


def test_detection_plane_of_other_shapes(frame):
    assert plane_values(P.detection_rows(frame(POWERS, bzero=5.0)))[:2] == [6.0, 7.0]
    cube = frame([[[1, 2], [3, 4]], [[10, 20], [30, 40]], [[100, 200], [300, 400]]])
    assert plane_values(P.detection_rows(cube)) == [10, 20, 30, 40]
    floats = frame([[[0.0, 0.0]], [[0.5, 2.0]], [[0.0, 0.0]]], sample_type="F32")
    assert plane_values(P.detection_rows(floats)) == [32768.0, 65535.0]
    four = frame([[[1]], [[2]], [[3]], [[4]]])
    assert P.detection_rows(four).count() == 0
    assert "3 axes" in P.detection_errors(four).first()["error"]


def brute_demosaic(raw, pattern):
    h, w = raw.shape
    rx, ry = RED[pattern]
    at = lambda y, x: int(raw[(abs(y) if y < h else 2 * h - 2 - y), (abs(x) if x < w else 2 * w - 2 - x)])
    out = np.zeros((h, w, 3), dtype=int)
    for y in range(h):
        for x in range(w):
            across = (at(y, x - 1) + at(y, x + 1)) // 2
            along = (at(y - 1, x) + at(y + 1, x)) // 2
            cross = (at(y, x - 1) + at(y, x + 1) + at(y - 1, x) + at(y + 1, x)) // 4
            corners = (at(y - 1, x - 1) + at(y - 1, x + 1) + at(y + 1, x - 1) + at(y + 1, x + 1)) // 4
            red_row, red_col = y % 2 == ry, x % 2 == rx
            if red_row and red_col:
                out[y, x] = at(y, x), cross, corners
            elif not red_row and not red_col:
                out[y, x] = corners, cross, at(y, x)
            elif red_row:
                out[y, x] = across, at(y, x), along
            else:
                out[y, x] = along, at(y, x), across
    return out


@pytest.mark.parametrize("pattern", sorted(RED))
@pytest.mark.parametrize("shape", [(4, 4), (7, 5), (13, 6)])
def test_demosaic_matches_brute_force_across_bands(frame, monkeypatch, pattern, shape):
    monkeypatch.setattr(P, "BAND_ROWS", 3)
    raw = np.random.default_rng(shape[0]).integers(0, 30000, shape)
    px = P.demosaic(frame(raw.tolist(), bayerpat=pattern)).collect()
    got = np.zeros((*shape, 3), dtype=int)
    for p in px:
        got[p["y"], p["x"]] = p["r"], p["g"], p["b"]
    assert len(px) == raw.size
    assert np.array_equal(got, brute_demosaic(raw, pattern))


def test_pattern_alone_does_not_demosaic(frame):
    mono = frame(POWERS)
    assert P.load_rgb(mono, pattern="RGGB").first()["notice"] == "AlreadyDebayeredMono"
    assert P.load_rgb(mono, pattern="RGGB", force=True).first()["notice"] == "Demosaiced"
    assert P.rgb_errors(mono, force=True).first()["error"] == "the mosaic layout is not known"
    assert P.rgb_errors(mono).count() == 0
    assert "three planes" in P.split_errors(mono).first()["error"]


def test_explicit_pattern_wins_over_the_header(frame):
    raw = frame(POWERS, bayerpat="nonsense")
    assert P.demosaic(raw).count() == 0
    assert P.demosaic(raw, "RGGB").count() == 16


def test_u8_frames_stay_8_bit(frame):
    px = P.load_rgb(frame([[1, 2], [3, 250]], sample_type="U8"))
    assert {(r["r"], r["depth"]) for r in px.collect()} == {(1, 8), (2, 8), (3, 8), (250, 8)}


def test_float_frames_are_scaled_by_their_own_maximum(frame):
    px = P.load_rgb(frame([[-1.0, 0.0, 2.0, float("inf")]], sample_type="F32"))
    assert [r["g"] for r in px.orderBy("x").collect()] == [0, 0, 65535, 65535]
    dark = P.load_rgb(frame([[-1.0, -2.0]], sample_type="F32"))
    assert {r["r"] for r in dark.collect()} == {0}
    mosaic = P.demosaic(frame([[0.4, 0.6], [1.6, 2.4]], sample_type="F32", bayerpat="RGGB"))
    assert mosaic.filter("x = 0 and y = 0").first()["r"] == 0


def test_write_back_inverts_the_scaling(frame):
    lines = frame(POWERS, bscale=2.0, bzero=100.0)
    frames = lines.select("frame_id", *P.DESCRIPTOR).distinct()
    back = P.to_scanlines(P.encode_rgb_as_source(P.debayer(lines, frames)))
    rows = {(r["plane"], r["y"]): r["samples"] for r in back.collect()}
    assert rows[(1, 0)] == [1.0, 2.0, 4.0, 8.0] and len(rows) == 12


def test_stretch_properties(frame, value):
    for m in (0.1, 0.5, 0.9):
        assert value(T.mtf(F.lit(m), F.lit(0.0))) == 0.0
        assert value(T.mtf(F.lit(m), F.lit(1.0))) == 1.0
        assert value(T.mtf(F.lit(m), F.lit(m))) == 0.5
    rng = np.random.default_rng(3)
    noise = np.clip(rng.normal(1000, 20, (40, 40)), 0, 30000).round()
    out = T.load_and_stretch(frame(noise.tolist()))
    got = np.array([r["r"] for r in out.collect()])
    assert abs(np.median(got) / 65535 - 0.25) < 0.25 * 0.05
    order = out.join(P.explode_samples(frame(noise.tolist())), ["frame_id", "y", "x"]).orderBy("raw", "r").collect()
    assert all(a["r"] <= b["r"] for a, b in zip(order, order[1:]))


def expected_median(samples):
    """Stretched median by the formulas: the clip rescales, so bright channels end up above target."""

    def mtf(m, x):
        return (m - 1) * x / ((2 * m - 1) * x - m)

    x = np.asarray(samples) / 65535
    med = np.median(x)
    shadows = max(med - 2.8 * 1.4826 * np.median(np.abs(x - med)), 0)
    return mtf(mtf(0.25, med - shadows), (med - shadows) / (1 - shadows)) * 65535


def test_linked_and_unlinked_stretch_differ(frame):
    rng = np.random.default_rng(4)
    cube = [np.clip(rng.normal(c, 100, (40, 40)), 0, 30000).round().tolist() for c in (500, 3000, 9000)]
    lines = frame(cube)
    medians = {}
    for linked in (False, True):
        rows = T.load_and_stretch(lines, linked=linked).collect()
        medians[linked] = [np.median([r[c] for r in rows]) for c in "rgb"]
    assert medians[False] == pytest.approx([expected_median(plane) for plane in cube], rel=0.01)
    assert np.ptp(medians[True]) > 5 * np.ptp(medians[False])


def test_render_toggles(frame):
    mosaic = frame(POWERS, bayerpat="RGGB")
    raw = T.render(mosaic, debayer=False, stretch=False)
    assert raw.first()["source"] == "RawMono"
    assert all(r["r"] == r["g"] == r["b"] for r in raw.collect())
    assert T.render(frame(POWERS), debayer=False, stretch=False).first()["source"] == "AlreadyDebayeredMono"


@pytest.mark.parametrize("w, h, mw, mh, fit", [(100, 50, 10, 10, (10, 5)), (1000, 1, 10, 10, (10, 1)), (3, 3, 9, 6, (6, 6)), (0, 5, 9, 9, (0, 0))])
def test_fit_dimensions(value, w, h, mw, mh, fit):
    column = R.fit_dimensions(F.lit(w), F.lit(h), F.lit(mw), F.lit(mh))
    assert tuple(value(column)) == fit


def test_regions_and_tiles(spark, value):
    assert value(R.tile_size(F.lit(3008), F.lit(3008))) == 256
    assert value(R.tile_size(F.lit(5), F.lit(9))) == 1
    assert value(R.tile_size(F.lit(100), F.lit(60))) == 6
    got = value(R.regions(F.lit(100), F.lit(60), F.lit(6)))
    assert [(r["x0"], r["y0"]) for r in got] == [(x, y) for y in (0, 27, 54) for x in (0, 47, 94)]
