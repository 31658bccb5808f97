from __future__ import annotations

import math
from collections import deque
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.operators import planes as P
from nightframes.operators import stars as D
from nightframes.session import staged

BZERO = 32768.0


def field(width, height, stars, background=1000.0):
    """Rippled background with Gaussians (x, y, sigma_x, sigma_y, peak), as raw samples."""
    y, x = np.mgrid[0:height, 0:width]
    v = background + (x * 7 + y * 13) % 5
    for sx, sy, gx, gy, peak in stars:
        v = v + peak * np.exp(-0.5 * (((x - sx) / gx) ** 2 + ((y - sy) / gy) ** 2))
    return (np.clip(np.floor(v + 0.5), 0, 65535) - BZERO).tolist()


def metrics(lines):
    frames = lines.select("frame_id", *P.DESCRIPTOR).distinct()
    return D.detect_stars(lines, frames).first()


def test_every_star_of_a_grid_is_found(frame):
    truth = [(20.0 + 30 * c, 20.0 + 30 * r, 2.0, 2.0, 5000.0) for r in range(3) for c in range(3)]
    lines = frame(field(100, 100, truth), bzero=BZERO)
    assert metrics(lines)["star_count"] == 9
    found = D.find_stars(P.detection_rows(lines)).collect()
    for x, y, *_ in truth:
        assert any(abs(s["x"] - x) < 0.1 and abs(s["y"] - y) < 0.1 for s in found)


def test_shape_of_a_gaussian(frame):
    s = metrics(frame(field(60, 60, [(30, 30, 2.0, 2.0, 5000.0)]), bzero=BZERO))
    assert s["star_count"] == 1
    for got, true in ((s["fwhm"], 2.3548 * 2), (s["hfr"], 1.2533 * 2)):
        assert 0.85 * true < got < true
    assert s["eccentricity"] < 0.05
    long = metrics(frame(field(60, 60, [(30, 30, 4.0, 2.0, 5000.0)]), bzero=BZERO))
    assert abs(long["eccentricity"] - 0.866) < 0.05


def hot_pixel():
    data = field(60, 60, [])
    data[30][30] = 60000.0 - BZERO
    return data


def test_rejected(frame):
    """Empty, hot pixel, border, saturated and too large: all in one pass over five frames."""
    cases = [
        field(160, 160, []),
        hot_pixel(),
        field(60, 60, [(0.0, 30.0, 2.0, 2.0, 5000.0)]),
        field(60, 60, [(30.0, 30.0, 2.0, 2.0, 200000.0)]),
        field(160, 160, [(80.0, 80.0, 12.0, 12.0, 5000.0)]),
    ]
    lines = reduce(DataFrame.unionByName, [frame(d, bzero=BZERO, frame_id=i) for i, d in enumerate(cases)])
    frames = lines.select("frame_id", *P.DESCRIPTOR).distinct()
    rows = D.detect_stars(lines, frames).collect()
    assert len(rows) == len(cases)
    for s in rows:
        assert (s["star_count"], s["hfr"], s["fwhm"], s["eccentricity"]) == (0, None, None, None)


def brute_components(mask):
    """Smallest run id reachable from every run, by flood fill over pixels."""
    h, w = mask.shape
    label = {}
    for y0 in range(h):
        for x0 in range(w):
            if not mask[y0, x0] or (y0, x0) in label:
                continue
            queue = deque([(y0, x0)])
            label[(y0, x0)] = (y0, x0)
            while queue:
                y, x = queue.popleft()
                for ny in range(max(y - 1, 0), min(y + 2, h)):
                    for nx in range(max(x - 1, 0), min(x + 2, w)):
                        if mask[ny, nx] and (ny, nx) not in label:
                            label[(ny, nx)] = (y0, x0)
                            queue.append((ny, nx))
    return label


def spiral(n):
    mask = np.zeros((n, n), dtype=bool)
    y = x = 0
    dy, dx = 0, 1
    mask[0, 0] = True
    while True:
        for _ in range(2):
            ny, nx = y + dy, x + dx
            far_y, far_x = y + 2 * dy, x + 2 * dx
            free = 0 <= ny < n and 0 <= nx < n and not mask[ny, nx]
            if free and not (0 <= far_y < n and 0 <= far_x < n and mask[far_y, far_x]):
                break
            dy, dx = dx, -dy
        else:
            return mask
        y, x = y + dy, x + dx
        mask[y, x] = True


def runs_of(mask, frame_id):
    out = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(int), [0]))))
        out += [(frame_id, y, int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    return out


@pytest.mark.parametrize("band_rows", [1, 3, 128])
def test_components_match_flood_fill(spark, band_rows):
    rng = np.random.default_rng(11)
    masks = {1: spiral(25), 2: rng.random((30, 150)) < 0.35, 3: rng.random((20, 20)) < 0.1, 4: np.ones((9, 200), dtype=bool)}
    comb = np.zeros((12, 40), dtype=bool)
    comb[:, ::2] = True
    comb[-1] = True
    masks[5] = comb
    rows = [r for f, m in masks.items() for r in runs_of(m, f)]
    runs = spark.createDataFrame(rows, "frame_id bigint, y int, x0 int, x1 int")
    got = {(r["frame_id"], r["run"]): r["label"] for r in D.label_runs(runs, band_rows).collect()}
    assert len(got) == len(rows)
    for f, mask in masks.items():
        label = brute_components(mask)
        same = {}
        for frame_id, y, x0, _ in rows:
            if frame_id == f:
                same.setdefault(label[(y, x0)], set()).add(got[(f, (y << 31) + x0)])
        assert all(len(s) == 1 for s in same.values())
        assert len({next(iter(s)) for s in same.values()}) == len(same)
        assert all(next(iter(s)) == (y << 31) + x for (y, x), s in same.items())


def test_bands_split_over_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        mask = np.random.default_rng(5).random((40, 60)) < 0.4
        runs = spark.createDataFrame(runs_of(mask, "a") + runs_of(mask, "b"), "frame_id string, y int, x0 int, x1 int")
        got = {(r["frame_id"], r["run"]): r["label"] for r in D.label_runs(runs, 16).collect()}
        label = brute_components(mask)
        for f, y, x0, _ in runs_of(mask, "a"):
            ty, tx = label[(y, x0)]
            assert got[("a", (y << 31) + x0)] == got[("b", (y << 31) + x0)] == (ty << 31) + tx
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_medians_of_stars_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(f, float(a), float(b), float(c)) for f in (1, 2) for a, b, c in rng.random((31 * f, 3))]
    stars = spark.createDataFrame(rows, "frame_id bigint, hfr double, fwhm double, eccentricity double")
    frames = spark.createDataFrame([(1,), (2,), (3,)], "frame_id bigint")
    want = [(f, len(own), *np.median(own, axis=0)) for f in (1, 2) for own in [np.array([r[1:] for r in rows if r[0] == f])]]
    got = sorted(map(tuple, D.star_stats(stars, frames).select("frame_id", "star_count", "hfr", "fwhm", "eccentricity").collect()))
    assert got[:2] == want and got[2][1:] == (0, None, None, None)


def test_mosaic_is_measured_at_half_resolution(frame):
    lines = frame(field(120, 120, [(60, 60, 4.0, 4.0, 5000.0)]), bzero=BZERO, bayerpat="RGGB")
    s = metrics(lines)
    assert (s["star_count"], s["plane_width"], s["plane_height"]) == (1, 60, 60)
    # Averaging two sites widens the star a little, so this is not biased low.
    assert s["fwhm"] == pytest.approx(2.3548 * 2, rel=0.15)


def test_float_planes_use_counted_background(spark, frame):
    data = (np.array(field(60, 60, [(30, 30, 2.0, 2.0, 5000.0)])) + BZERO).tolist()
    rows = P.detection_rows(frame(data, sample_type="F32"))
    want = D.plane_background(P.detection_rows(frame(data, sample_type="I16", bzero=0.0))).first()
    got = D.plane_background(rows).first()
    assert tuple(got) == pytest.approx(tuple(want))
    assert D.find_stars(rows, staged(D.plane_background(rows), "bg")).agg(F.count("*")).first()[0] == 1


@pytest.mark.parametrize("columns", [3, 24])
def test_a_long_snake_ends_in_few_rounds(spark, monkeypatch, columns):
    """One line of pixels up and down all bands: a chain of band components, one component in the end."""
    rows, band = 64, 4
    lit = {(y, 2 * c) for c in range(columns) for y in range(rows)}
    lit |= {((rows - 1) * (c % 2 == 0), 2 * c + 1) for c in range(columns - 1)}
    runs = [(1, y, x, x) for y, x in sorted(lit)] + [(2, y, 0, 0) for y in range(0, rows, 2)]
    df = spark.createDataFrame(runs, "frame_id bigint, y int, x0 int, x1 int")
    rounds = []
    plain = D.staged
    monkeypatch.setattr(D, "staged", lambda df, name: (rounds.append(name), plain(df, name))[1])
    found = D.label_runs(df, band_rows=band).collect()
    assert len({r["label"] for r in found if r["frame_id"] == 1}) == 1
    assert {r["label"] for r in found if r["frame_id"] == 1} == {0}
    assert len({r["label"] for r in found if r["frame_id"] == 2}) == rows // 2
    assert rounds.count("moved") <= math.log2(columns * rows / band) + 2
