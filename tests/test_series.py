from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from nightframes.operators import series as T

EVENING = 1782165600.0  # 2026-06-22T22:00:00


def points(spark, rows):
    return spark.createDataFrame(
        [("s", "mean", float(t), "", None if v is None else float(v), f"f{i}") for i, (t, v) in enumerate(rows)],
        "session_id string, metric string, time double, time_str string, value double, path string",
    )


def test_csv_text(spark, tmp_path):
    rows = [
        ("s", "mean", 160.25, "1970-01-01T00:02:40.25", 8.0, "b.fits"),
        ("s", "mean", 100.0, "1970-01-01T00:01:40", 7.5, "a.fits"),
    ]
    series = spark.createDataFrame(rows, "session_id string, metric string, time double, time_str string, value double, path string")
    out = str(tmp_path / "csv")
    T.write_series_csv(series, out)
    lines = []
    for name in sorted(glob.glob(f"{out}/session_id=s/metric=mean/*.csv")):
        text = open(name).read().splitlines()
        assert text[0] == "time_iso,epoch_seconds,value"
        lines += text[1:]
    assert lines == ["1970-01-01T00:01:40,100,7.5", "1970-01-01T00:02:40.25,160.25,8"]
    with pytest.raises(Exception):
        T.write_series_csv(series, out)


@pytest.mark.parametrize("span, step", [(4.0, 1.0), (8.0, 2.0), (20.0, 5.0), (400.0, 100.0), (0.4, 0.1), (0.0, 1.0)])
def test_nice_step(value, span, step):
    assert value(T.nice_step(F.lit(span))) == pytest.approx(step)


def test_value_axis(value):
    a = value(T.value_axis(F.lit(1103.0), F.lit(1748.0)))
    assert (a["lo"], a["hi"], a["step"], a["count"]) == (1000.0, 1800.0, 200.0, 4)
    flat = value(T.value_axis(F.lit(500.0), F.lit(500.0)))
    assert flat["lo"] < 500 < flat["hi"]


def ticks(spark, rows):
    return T.time_ticks(T.series_axes(points(spark, rows))).orderBy("i").collect()


def test_time_ticks_on_the_half_hour(spark):
    got = ticks(spark, [(EVENING, 1), (EVENING + 3 * 3600, 2)])
    assert [t["label"] for t in got] == ["22:00", "22:30", "23:00", "23:30", "00:00", "00:30", "01:00"]
    assert [t["date_label"] for t in got] == ["2026-06-22", "", "", "", "2026-06-23", "", ""]


def test_time_ticks_stay_inside_the_range(spark):
    got = ticks(spark, [(EVENING + 7.5, 1), (EVENING + 3 * 3600 - 128, 2)])
    assert all(EVENING + 7.5 <= t["tick"] <= EVENING + 3 * 3600 - 128 for t in got)
    assert all(t["tick"] % 60 == 0 for t in got)


def test_single_instant_has_one_tick(spark):
    for rows in ([(EVENING, 1)], [(EVENING + 0.25, 1), (EVENING + 0.5, 2)]):
        got = ticks(spark, rows)
        assert len(got) == 1 and got[0]["tick"] == rows[0][0]


def test_long_ranges_tick_by_the_day(spark):
    got = ticks(spark, [(EVENING, 1), (EVENING + 30 * 86400, 2)])
    assert len(got) == 30 and all(t["date_label"] for t in got)


def test_plot_points(spark):
    series = points(spark, [(EVENING, 100), (EVENING + 3600, 150), (EVENING + 7200, 200)])
    got = T.plot_points(series).orderBy("time").collect()
    assert [p["x"] for p in got] == [0.0, 0.5, 1.0]
    assert got[0]["y"] > got[1]["y"] > got[2]["y"]
    assert (got[1]["time_label"], got[1]["value_label"]) == ("2026-06-22 23:00:00", "150")
    alone = T.plot_points(points(spark, [(EVENING, 100)])).first()
    assert (alone["x"], alone["y"]) == (0.5, 0.5)


def test_ties_in_time_are_ordered_by_path(spark):
    series = points(spark, [(5, 1), (5, 2), (1, 3)])
    assert [r["path"] for r in T.ordered(series).collect()] == ["f2", "f0", "f1"]


def test_metric_rules(spark):
    rows = [("s", "a", 1.0, "", 2.0, True, 0, None), ("s", "b", 2.0, "", 3.0, True, 4, 1.5), ("s", "c", 3.0, "", 4.0, False, None, None)]
    frames = spark.createDataFrame(
        rows,
        "session_id string, path string, time double, time_str string, mean double, stars_measured boolean, star_count bigint, hfr double",
    )
    values = T.metric_values(frames)
    got = {(r["path"], r["metric"]): r["value"] for r in values.collect()}
    assert got[("a", "star_count")] == 0.0 and got[("a", "hfr")] is None
    assert got[("c", "star_count")] is None and got[("c", "mean")] == 4.0
    summary = {r["metric"]: (r["points"], r["unavailable"]) for r in T.series_summary(values).collect()}
    assert summary == {"mean": (3, 0), "star_count": (2, 1), "hfr": (1, 2)}
    assert T.build_series(values, "hfr").count() == 1


def test_metric_catalog(spark):
    rows = T.metric_catalog(spark).orderBy("ord").collect()
    assert [r["family"] for r in rows] == ["pixel"] * 10 + ["star"] * 4
    assert T.DEFAULT_METRIC == {"pixel": "mean", "star": "hfr"}


def test_csv_values_do_not_depend_on_how_events_are_split(spark, tmp_path):
    """A sum of doubles depends on its order; taken in event order it is the same from every file layout."""
    from nightframes.plans.sessions import series_csv_rows

    values = [0.1, 1e16, 0.7, -1e16, 0.3, 29.27, 122.79, 2.11, 0.2]
    rows = [(i, f"2024-01-01 00:00:{i:02d}", u, v) for u in (1, 2) for i, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, value double")
    events = events.withColumn("ts", F.to_timestamp_ntz("ts")).withColumn("event_id", F.col("event_id") * 2 + F.col("user_id"))
    running = 0.0
    for v in values:
        running += v
    for name, parts in (("one", 1), ("many", 7)):
        dealt = events.repartition(parts, F.xxhash64("event_id")) if parts > 1 else events.coalesce(1)
        dealt.write.parquet(str(tmp_path / name / "events.parquet"))
        got = series_csv_rows(spark, str(tmp_path / name)).filter("metric = 'mean'").collect()
        assert {r["session_id"]: float(r["csv_value"]) for r in got} == {u: running / len(values) for u in (1, 2)}
