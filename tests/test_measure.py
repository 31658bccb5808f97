"""Shared measurement and document bundles, against measuring apart."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.operators import incremental as N
from nightframes.operators import measure as M
from nightframes.operators import planes as P
from nightframes.operators import stars as D
from nightframes.operators import stats as A
from nightframes.session import staged


def field(height, width, stars, seed=0):
    y, x = np.mgrid[:height, :width]
    v = 1000.0 + (7 * x + 13 * y) % 5 + np.random.default_rng(seed).integers(0, 3, (height, width))
    for cx, cy, peak in stars:
        v += peak * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 6)
    return np.round(v)


@pytest.fixture
def lines(frame):
    star = field(40, 40, [(20, 20, 3000), (10, 28, 1500)])
    cube = [field(30, 30, [(12, 15, 2500)], k) for k in range(3)]
    frames = [
        frame((star - 32768).tolist(), bzero=32768.0, frame_id=1),
        frame((star / 65535).tolist(), sample_type="F32", frame_id=2),
        frame((star).tolist(), sample_type="F64", bscale=2.0, frame_id=3),
        frame([c.tolist() for c in cube], frame_id=4),
        frame([(c / 65535).tolist() for c in cube], sample_type="F32", frame_id=5),
        frame([c.tolist() for c in cube], sample_type="I32", frame_id=6),
        frame(star.tolist(), bayerpat="GRBG", frame_id=7),
        frame(star.tolist(), sample_type="F32", bayerpat="RGGB", frame_id=8),
        frame(star.tolist(), bayerpat="none", frame_id=9),
        frame([c.tolist() for c in cube[:2]], frame_id=10),
        frame([[-5, 3, 40000 - 32768]], frame_id=11),
        frame([[float("nan"), 1.0], [2.0, float("inf")]], sample_type="F64", frame_id=12),
    ]
    return staged(reduce(DataFrame.unionByName, frames), "lines")


def frames_of(lines):
    return lines.filter("plane = 0 and y = 0").select("frame_id", *P.DESCRIPTOR)


def by_frame(df):
    return {r["frame_id"]: r.asDict() for r in df.collect()}


def near(a, b):
    assert a.keys() == b.keys()
    for k, row in a.items():
        for c, value in row.items():
            same = value == b[k][c] or value == pytest.approx(b[k][c], rel=1e-9, abs=1e-9)
            assert same, (k, c)


def test_shared_measurement_is_that_of_both_apart(spark, lines):
    frames = frames_of(lines)
    both = by_frame(N.measure_frames(lines, frames, pixel_stats=True, stars=True))
    stats = by_frame(A.pixel_stats(P.explode_samples(lines)))
    stars = by_frame(D.detect_stars(lines, frames))
    near(stats, {k: both[k] for k in stats})
    near(stars, {k: both[k] for k in stars})
    assert {k for k, r in both.items() if r["star_error"]} == {9, 10}
    assert both[1]["star_count"] == 2 and both[4]["star_count"] == 1 and both[8]["star_count"] >= 1
    only = by_frame(N.measure_frames(lines, frames, pixel_stats=True))
    near(stats, only)
    assert set(by_frame(N.measure_frames(lines, frames, pixel_stats=False, stars=True))[1]) >= {"star_count", "star_error"}


def test_background_of_a_frame_is_its_own_median(spark, lines):
    stats, background = M.shared_statistics(lines, planes=True)
    stats, background = by_frame(stats), by_frame(background)
    apart = by_frame(D.plane_background(P.detection_rows(lines)))
    for k in (1, 2, 3, 4, 5, 6):
        assert (background[k]["median"], background[k]["mad"]) == (stats[k]["median"], stats[k]["mad"])
    # frames without a detection plane and without enough finite samples have their own numbers only
    assert set(background) == set(stats) and set(apart) <= set(background)
    near({k: r for k, r in apart.items() if k != 12}, {k: background[k] for k in apart if k != 12})
    assert background[7]["median"] == pytest.approx(apart[7]["median"])
    assert M.shared_statistics(lines, planes=False)[1] is None


def test_pixels_are_counted_by_one_exchange(spark, lines):
    """Counting frames and planes of all shapes deals rows once, besides bringing a mosaic's lines together."""
    samples = M.tagged_samples(lines, True).filter("counted").groupBy(*M.KEYS, "key").count()
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [frame_id") == 2


def test_bundle(spark, lines):
    frames = frames_of(lines)
    cards = spark.createDataFrame(
        [
            (1, 2, "OBJECT", "M 31", "target"), (1, 1, "BITPIX", "16", ""), (1, 3, "HISTORY", None, "made"),
            (4, 1, "NAXIS", "3", ""), (4, 2, "NAXIS3", "3", ""), (99, 1, "OBJECT", "nobody's", ""),
        ],
        "frame_id bigint, ord int, name string, value string, comment string",
    )
    out = by_frame(N.document_bundle(frames, cards, N.measure_frames(lines, frames, True, True)))
    assert len(out) == 12 and {k for k, r in out.items() if r["channel"] == "G"} == {4, 5, 6}
    assert [(c["name"], c["value"], c["comment"]) for c in out[1]["cards"]] == [
        ("BITPIX", "16", ""), ("OBJECT", "M 31", "target"), ("HISTORY", "", "made"),
    ]
    summary = [(f["label"], f["value"]) for f in out[1]["summary"]]
    assert summary[0][0] == "Resolution" and ("Object", "M 31") in summary
    assert [x for x, _ in summary] == sorted([x for x, _ in summary], key="Resolution Bit depth Channels Object".index)
    assert out[2]["cards"] == [] and out[2]["summary"] == []
    assert all(len(r["heights"]) == 256 for r in out.values())
    assert out[1]["star_count"] == 2 and out[9]["star_error"]
    nothing = N.document_bundle(frames, cards.limit(0), N.measure_frames(lines, frames, True, True))
    assert nothing.filter(F.size("cards") > 0).count() == 0
