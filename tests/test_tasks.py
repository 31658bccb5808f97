"""Tasks follow the number of rows, and what is costly is computed once."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from nightframes.functions import scalars as S
from nightframes.operators import catalog as C
from nightframes.operators import headers as H
from nightframes.operators import incremental as N
from nightframes.operators import stars as D
from nightframes.operators import stats as A
from nightframes.operators import stretch as T
from nightframes.plans import fixtures as X
from nightframes.session import TASK_ROWS, attach, dealt, staged

SF_DIR = "/root/testdata/sf0.001"
MANY = 40 * TASK_ROWS


def tasks(df):
    return df.rdd.getNumPartitions()


def test_a_small_table_is_spread_by_its_rows(spark):
    assert tasks(X.spread(spark.range(0, 1000, 1, 1), 10)) == 100
    assert tasks(X.spread(spark.range(0, 1000, 1, 1), 1000)) == 8


def test_star_fields_are_those_of_the_sql(spark):
    rows = X.star_lines(spark, "/root/testdata/sf0.01").select("frame_id", "y", F.posexplode("samples").alias("x", "raw"))
    got = rows.filter("frame_id < 120").toPandas()  # all different fields
    con = duckdb.connect()
    con.execute("create view supplier as select * from '/root/testdata/sf0.01/supplier.parquet'")
    differing = f"""with {X.STAR_SQL} select count(*) filter (g.raw + 32768 = s.v), count(*)
 from got g full join (select * from star where frame_id < 120) s using (frame_id, y, x)"""
    same, rows = con.execute(differing).fetchone()
    assert same == rows > 0


def test_partitions_asked_for_are_kept(spark):
    assert tasks(dealt(spark.range(100), ["id"], MANY).groupBy("id").count()) == 40
    assert tasks(dealt(spark.range(100), ["id"], 1)) == 8


def test_medians_are_dealt_by_the_number_of_counts(spark):
    counts = spark.range(100).selectExpr("id % 7 as frame_id", "cast(id as double) as v", "1L as n", "1D as saturation")
    assert tasks(A.median_and_mad(counts, rows=MANY)) == 40
    assert tasks(A.stats_from_counts(counts, rows=MANY)) == 40


def test_stretch_counts_are_dealt_by_the_number_of_pixels(spark, monkeypatch):
    monkeypatch.setattr("nightframes.session.TASK_ROWS", 5)
    rgb = spark.range(0, 100, 1, 1).selectExpr("1 as frame_id", "cast(id as int) as y", *[f"cast(id as int) as {c}" for c in "rgb"], "16 as depth")
    plan = T.channel_counts(rgb)._jdf.queryExecution().toString()
    assert "RepartitionByExpression [frame_id" in plan and ", 20" in plan
    row = T.stretch_params(rgb, linked=True).first()
    assert row["median"] == pytest.approx(49.5 / 65535)


def test_stretch_counts_of_a_slice_stay_in_its_task(spark, monkeypatch):
    monkeypatch.setattr("nightframes.session.TASK_ROWS", 5)
    columns = [f"cast(id % 10 as int) as {c}" for c in "rgb"]
    rgb = spark.range(0, 300, 1, 1).selectExpr("id % 2 as frame_id", "cast(id as int) as y", *columns, "16 as depth")
    counts = T.channel_counts(rgb)
    assert tasks(counts) == 60  # no shuffle that Spark merges after the one by slices
    assert {r["n"] for r in counts.groupBy("frame_id", "channel", "v").agg(F.sum("n").alias("n")).collect()} == {30}
    got = {(r["frame_id"], r["channel"]): r["median"] for r in T.stretch_params(rgb).collect()}
    assert got == {(f, c): pytest.approx((4 + f) / 65535) for f in (0, 1) for c in (0, 1, 2)}


def small_frames(spark):
    """40 frames of the values 0 to 4."""
    return spark.range(0, 200, 1, 1).selectExpr(
        "id % 40 as frame_id", "cast(id div 40 as double) as raw", "'U8' as sample_type", "1D as bscale", "0D as bzero"
    )


def test_small_frames_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr("nightframes.session.TASK_ROWS", 5)
    counts = A.value_counts(small_frames(spark))
    assert tasks(counts) == 40
    assert counts.count() == 200 and counts.agg(F.sum("n")).first()[0] == 200


def test_a_large_frame_is_counted_before_it_moves(spark, monkeypatch):
    monkeypatch.setattr("nightframes.session.TASK_ROWS", 5)
    rows = small_frames(spark).withColumn("frame_id", F.least("frame_id", F.lit(38)))
    assert tasks(A.value_counts(rows)) <= 8
    assert A.value_counts(rows).count() == 195


def test_order_statistics_are_dealt_by_the_number_of_samples(spark, monkeypatch):
    monkeypatch.setattr("nightframes.session.TASK_ROWS", 5)
    for most in (5, 10**6):  # without and with a broadcast
        monkeypatch.setattr("nightframes.operators.stats.BROADCAST_ROWS", most)
        found = A.order_statistics(A.in_order(small_frames(spark).withColumnRenamed("raw", "v")))[1]
        assert tasks(found) == 40
        assert {(r["median"], r["mad"]) for r in found.collect()} == {(2.0, 1.4826)} and found.count() == 40


def test_tables_that_grow_with_the_frames_are_not_broadcast(spark, frame):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    ids = staged(spark.range(0, 100, 1, 1).selectExpr("id as frame_id", "id % 3 as v"), "ids")
    rows = staged(ids.selectExpr("frame_id", "v as raw"), "rows")
    joined = attach(rows, ids, ["frame_id"], F.col("raw"), broadcast_rows=0)
    assert "Broadcast" not in plan(joined) and joined.count() == 100

    lines = frame([[float((x * y) % 5) for x in range(6)] for y in range(6)])
    measured = N.measure_frames(lines, lines.filter("y = 0").drop("samples", "y", "plane"))
    assert "Broadcast" not in plan(measured) and measured.first()["count"] == 36

    runs = "id as frame_id, id as label, 1 as y, 0 as x0, 0D as background, array(1D, 3D) as values"
    accepted = "id as frame_id, id as label, 2L as area, 4D as flux, 0.75D as cx, 1D as cy"
    tables = (staged(spark.range(1).selectExpr(*columns.split(", ", 5)), "stars") for columns in (runs, accepted))
    stars = D.measure(*tables)
    assert "Broadcast" not in plan(stars) and stars.first()["flux"] == 4


CARDS = "frame_id bigint, ord int, name string, value string"


def test_headers_are_dealt_by_the_number_of_cards(spark):
    cards = spark.createDataFrame(
        [(1, 2, "OBJECT", "second"), (1, 1, "OBJECT", "first"), (1, 3, "GAIN", "1.5"), (2, 1, "OBJECT", "b"), (2, 2, "NAXIS", "2")], CARDS
    )
    assert tasks(C.catalog(cards, MANY)) == 40
    assert {r["frame_id"]: r["object"] for r in C.catalog(cards, MANY).collect()} == {1: "first", 2: "b"}
    pairs = spark.createDataFrame([(1, 2)], "source_id bigint, target_id bigint")
    assert tasks(H.missing_cards(cards, pairs, MANY)) == 40
    assert [r["name"] for r in H.missing_cards(cards, pairs, MANY).collect()] == ["GAIN"]


def test_session_frames_are_dealt_by_the_number_of_events(spark):
    assert tasks(X.session_frames(spark, SF_DIR)) == 8


def test_a_bundle_holds_the_cards_of_its_frame(spark, frame):
    lines = frame([[float((x * y) % 5) for x in range(6)] for y in range(6)])
    frames = lines.filter("y = 0").drop("samples", "y", "plane")
    measured = N.measure_frames(lines, frames, pixel_stats=True, stars=True)
    cards = spark.createDataFrame([(1, 2, "GAIN", "1", ""), (1, 1, "OBJECT", "M 31", "")], CARDS + ", comment string")
    row = N.document_bundle(frames, cards, measured).first()
    assert [c["name"] for c in row["cards"]] == ["OBJECT", "GAIN"]


def test_a_time_stamp_is_matched_once(spark):
    text = F.col("t")
    shown = spark.createDataFrame([(" 2024-02-03T04:05:06.5ZZ ",)], "t string").select(S.parse_date_obs(text).alias("s"))
    plan = shown._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract") == 0 and plan.count("rlike") == 1
    assert shown.first()["s"] == 1706933106.5


@pytest.mark.parametrize("text", ["1,2,3,4,5,6", "-2024-01-01T00:00:00", "2024-13-01T00:00:00", "", "2024-01-01T00:00:61"])
def test_other_text_is_no_time_stamp(value, text):
    assert value(S.parse_date_obs(F.lit(text))) is None
