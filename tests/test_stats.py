from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightframes.operators import planes as P
from nightframes.operators import stats as A
from nightframes.session import attach, staged


def samples(spark, values, sample_type="I16", bzero=0.0, frame_id=1):
    rows = [(frame_id, float(v), sample_type, 1.0, bzero) for v in values]
    return spark.createDataFrame(rows, "frame_id bigint, raw double, sample_type string, bscale double, bzero double")


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


HAND = [10, 10, 10, 10, 20, 20, 30, 100]


def test_hand_computed_values(spark):
    s = only(A.integer_stats(samples(spark, HAND)))
    assert (s["min"], s["max"], s["mean"], s["median"], s["mode"]) == (10, 100, 26.25, 15, 10)
    assert (s["min_count"], s["max_count"], s["count"], s["zeros"], s["saturated"]) == (4, 1, 8, 0, 0)
    assert s["saturation"] == 32767
    assert s["mad"] == pytest.approx(7.413)
    assert s["sigma"] == pytest.approx(math.sqrt(823.4375))
    assert sum(s["histogram"]) == 8 and s["histogram"][0] == 4 and s["histogram"][255] == 1


def test_mode_prefers_the_lower_value(spark):
    assert only(A.integer_stats(samples(spark, [5, 5, 9, 9, 7])))["mode"] == 5


def test_constant_frame(spark):
    for stats in (A.integer_stats(samples(spark, [7] * 6)), A.general_stats(samples(spark, [7] * 6))):
        s = only(stats)
        assert (s["sigma"], s["mad"], s["mode"], s["min"], s["max"]) == (0, 0, 7, 7, 7)
        assert s["histogram"][0] == 6


def test_saturated_pixels_follow_the_sample_type(spark):
    s = only(A.integer_stats(samples(spark, [32767, 32767, 0], bzero=32768.0)))
    assert (s["saturated"], s["saturation"]) == (2, 65535)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 501])
def test_both_paths_agree(spark, n):
    values = np.random.default_rng(n).integers(-500, 500, n).tolist()
    a, b = only(A.integer_stats(samples(spark, values))), only(A.general_stats(samples(spark, values)))
    for c in ("min", "max", "median", "zeros", "min_count", "max_count", "count", "histogram"):
        assert a[c] == b[c], c
    for c in ("mean", "sigma", "mad"):
        assert a[c] == pytest.approx(b[c], rel=1e-9, abs=1e-12), c


@pytest.mark.parametrize("seed, kind", [(2, "ties"), (3, "outlier"), (4, "even")])
def test_blocks_of_any_size_give_the_same_result(spark, monkeypatch, seed, kind):
    """Small blocks bound the deviations more closely than the usual setting."""
    rng = np.random.default_rng(seed)
    n = 1000 if kind == "even" else 1001
    values = rng.normal(size=n)
    if kind == "ties":
        values = np.round(values, 1)
    if kind == "outlier":
        values[0] = 1e12
    small = np.full(20, 2.5)
    df = samples(spark, values.tolist(), "F64").unionByName(samples(spark, small.tolist(), "F64", frame_id=2))
    with monkeypatch.context() as m:
        m.setattr(A, "BLOCK_BITS", 4)
        narrowed = {r["frame_id"]: r for r in A.general_stats(df).collect()}
    sorted_ = {r["frame_id"]: r for r in A.general_stats(df).collect()}
    assert narrowed.keys() == sorted_.keys()
    for frame_id, want in sorted_.items():
        for c in A.STAT_COLUMNS:
            assert narrowed[frame_id][c] == pytest.approx(want[c], rel=1e-9, abs=1e-12), c
    assert sorted_[1]["median"] == np.median(values)
    assert sorted_[1]["mad"] == pytest.approx(1.4826 * np.median(np.abs(values - np.median(values))))


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_median_and_deviation_by_rank(spark, monkeypatch, bits):
    monkeypatch.setattr(A, "BLOCK_BITS", bits)
    rng = np.random.default_rng(9)
    frames = {
        1: np.exp(rng.normal(size=801) * 4), 2: rng.normal(size=500), 3: np.full(64, 2.5), 4: np.array([7.0]),
        5: np.array([1.0, 1.0, 5.0, 9.0]), 6: np.round(rng.normal(size=300), 1), 7: np.repeat([0.0, 1e300], 40),
    }
    rows = [(k, float(v)) for k, values in frames.items() for v in values]
    df = spark.createDataFrame(rows, "frame_id bigint, v double").repartition(5)
    got = {r["frame_id"]: r for r in A.order_statistics(A.in_order(df))[1].collect()}
    assert got.keys() == frames.keys()
    for k, values in frames.items():
        median = np.median(values)
        assert got[k]["median"] == median
        assert got[k]["mad"] == pytest.approx(1.4826 * np.median(np.abs(values - median)), rel=1e-12)
    assert {r["frame_id"]: r["median"] for r in A.frame_medians(df).collect()} == {k: r["median"] for k, r in got.items()}


def test_one_value_does_not_land_in_one_task(spark):
    """A constant frame that holds all rows is dealt by place."""
    rows = spark.range(20_000).selectExpr("1L as frame_id", "2.5D as v", "0 as plane", "cast(id div 100 as int) as y", "cast(id % 100 as int) as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in A.in_order(rows).groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 12_000
    moments, found = map(only, A.order_statistics(A.in_order(rows)))
    assert (found["median"], found["mad"], moments["total"], moments["sigma"]) == (2.5, 0, 20_000, 0)


def test_ranks_take_a_fixed_number_of_jobs(spark):
    def jobs(n):
        df = spark.createDataFrame([(i % 3, float(i * i % 1009)) for i in range(n)], "frame_id bigint, raw double")
        df = staged(df.selectExpr("*", "1.0D as bscale", "0.0D as bzero"), "samples")
        spark.sparkContext.setJobGroup(f"ranks-{n}", "")
        A.general_stats(df).collect()
        spark.sparkContext.setJobGroup("rest", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranks-{n}"))

    assert 0 < jobs(50_000) <= jobs(30) + 2


def test_nonfinite_samples_are_counted_apart(spark):
    s = only(A.general_stats(samples(spark, [1.0, 2.0, 3.0, float("nan"), float("inf"), float("-inf")], "F32")))
    assert (s["min"], s["max"], s["mean"], s["median"], s["count"], s["nonfinite"]) == (1, 3, 2, 2, 3, 3)
    s = only(A.general_stats(samples(spark, [float("nan")], "F32")))
    assert (s["count"], s["nonfinite"], s["mean"], sum(s["histogram"])) == (0, 1, 0, 0)


def test_cube_is_measured_on_green(spark, frame):
    cube = [[[1, 2]], [[10, 40]], [[100, 200]]]
    s = only(A.pixel_stats(P.explode_samples(frame(cube))))
    assert (s["min"], s["max"], s["count"], s["saturation"]) == (10, 40, 2, 32767)
    negative = only(A.pixel_stats(P.explode_samples(frame([[[0, 0]], [[-5, 3]], [[0, 0]]]))))
    assert negative["min"] == 0
    plain = only(A.pixel_stats(P.explode_samples(frame([[-5, 3]]))))
    assert plain["min"] == -5
    wide = only(A.pixel_stats(P.explode_samples(frame(cube, sample_type="I32"))))
    assert (wide["saturation"], wide["saturated"]) == (40, 1)


def test_four_planes_are_blended(spark, frame):
    s = only(A.pixel_stats(P.explode_samples(frame([[[1]], [[2]], [[3]], [[4]]]))))
    assert (s["count"], s["median"]) == (4, 2.5)


def test_inverted_scale_takes_the_general_path(spark, frame):
    s = only(A.pixel_stats(P.explode_samples(frame([[1, 2, 3]], bscale=-1.0, bzero=10.0))))
    assert (s["min"], s["max"], s["saturation"], s["saturated"]) == (7, 9, 9, 1)


def test_histogram_levels(spark):
    hist = spark.range(1).select(F.array(*[F.lit(v).cast("bigint") for v in [0, 1, 100, 0]]).alias("h"))
    row = hist.select(
        A.histogram_levels(F.col("h"), 4, rows=10).alias("linear"),
        A.histogram_levels(F.col("h"), 2, rows=10, log=True).alias("log"),
        A.histogram_levels(F.col("h"), 8, rows=1).alias("wide"),
        A.histogram_heights(F.col("h")).alias("heights"),
    ).first()
    assert row["linear"] == [0, 1, 40, 0]
    assert row["log"] == [round(40 * math.log(2) / math.log(101)), 40]
    assert row["wide"] == [0, 0, 1, 1, 4, 4, 0, 0]
    assert row["heights"] == pytest.approx([0, math.log(2) / math.log(101), 1, 0])
    empty = spark.range(1).select(A.histogram_heights(F.array_repeat(F.lit(0).cast("bigint"), 4)).alias("h"))
    assert empty.first()["h"] == [0, 0, 0, 0]


def test_attach_gives_the_same_rows_with_and_without_broadcast(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("frame_id"), "id")
    small = staged(spark.range(2).select(F.col("id").alias("frame_id"), (F.col("id") * 10).alias("p")), "small")
    for how in ("inner", "left"):
        a = attach(rows, small, ["frame_id"], F.col("id"), how)
        b = attach(rows, small, ["frame_id"], F.col("id"), how, broadcast_rows=0)
        assert sorted(map(str, a.select("frame_id", "id", "p").collect())) == sorted(
            map(str, b.select("frame_id", "id", "p").collect())
        )
