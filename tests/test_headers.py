from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.operators import catalog as C
from nightframes.operators import headers as H


def cards(spark, **frames):
    rows = [(f, i + 1, n, v) for f, pairs in frames.items() for i, (n, v) in enumerate(pairs)]
    return spark.createDataFrame(rows, "frame_id string, ord int, name string, value string")


def pair(spark, source, target):
    return spark.createDataFrame([(source, target)], "source_id string, target_id string")


def merged(spark, source, target):
    out = H.missing_cards(cards(spark, s=source, t=target), pair(spark, "s", "t"))
    return [(r["name"], r["value"]) for r in out.orderBy("ord").collect()]


def test_only_missing_cards_are_copied(spark):
    source = [("OBJECT", "M31"), ("GAIN", "100"), ("BZERO", "32768"), ("NAXIS1", "10"), ("GAIN", "200")]
    assert merged(spark, source, [("OBJECT", "mine")]) == [("GAIN", "100")]


def test_commentary_is_always_appended(spark):
    source = [("HISTORY", None), ("HISTORY", None), ("NOTE", None), ("NOTE", "late"), ("LOG", "early"), ("LOG", None)]
    target = [("HISTORY", None)]
    assert merged(spark, source, target) == [("HISTORY", None), ("HISTORY", None), ("NOTE", None), ("LOG", "early"), ("LOG", None)]


def test_cfa_cards_stay_off_a_cube(spark):
    source = [("BAYERPAT", "RGGB"), ("XBAYROFF", "0"), ("FILTER", "L")]
    cube = [("NAXIS", "3"), ("NAXIS3", "3")]
    assert merged(spark, source, cube) == [("FILTER", "L")]
    assert merged(spark, source, [("NAXIS", "3"), ("NAXIS3", "4")]) == source
    assert H.copied_counts(cards(spark, s=source, t=cube), pair(spark, "s", "t")).first()["copied"] == 1


def test_nothing_missing_counts_zero(spark):
    both = cards(spark, s=[("OBJECT", "a")], t=[("OBJECT", "b")])
    assert H.copied_counts(both, pair(spark, "s", "t")).first()["copied"] == 0


@pytest.mark.parametrize(
    "name, reserved",
    [("NAXIS", True), ("NAXIS3", True), ("NAXISA", False), ("TFORM12", True), ("TFORM", False), ("ZVAL1", True), ("ZVALX", False), ("OBJECT", False), ("END", True), ("BLANK", True)],
)
def test_reserved(value, name, reserved):
    assert value(H.is_reserved(F.lit(name))) is reserved


def test_scaling_takes_the_first_card(spark):
    c = cards(spark, a=[("BZERO", "1"), ("BZERO", "2"), ("BLANK", "0"), ("OBJECT", "x")])
    assert sorted((r["name"], r["value"]) for r in H.carried_with_scaling(c).collect()) == [("BLANK", "0"), ("BZERO", "1"), ("OBJECT", "x")]


def test_output_cards(spark):
    c = cards(spark, a=[("BZERO", "1"), ("OBJECT", "x"), ("BAYERPAT", "RGGB")])
    plain = H.output_cards(c, 1.0, 0.0)
    assert {r["name"] for r in plain.collect()} == {"OBJECT", "BAYERPAT"}
    scaled = H.add_history(H.output_cards(c, 1.0, 32768.0, ("bayerpat",)), "split").orderBy("ord").collect()
    assert [(r["name"], r["value"]) for r in scaled] == [("BZERO", "32768.0"), ("BSCALE", "1.0"), ("OBJECT", "x"), ("HISTORY", None)]
    assert scaled[-1]["comment"] == "split"


def test_catalog_uses_card_types(spark):
    rows = [
        ("a", 1, "NAXIS", "2", "number"),
        ("a", 2, "OBJCTRA", "20.5", "string"),
        ("a", 3, "OBJECT", "42", "number"),
        ("a", 4, "GAIN", "x", "number"),
        ("a", 5, "XBINNING", "2", "number"),
        ("a", 6, "YBINNING", "1", "number"),
    ]
    c = spark.createDataFrame(rows, "frame_id string, ord int, name string, value string, vtype string")
    got = C.catalog(c).first()
    assert (got["ra_deg"], got["ra_text"], got["object"], got["gain"]) == (None, "20.5", None, None)
    assert tuple(got["binning"]) == (2, 1)
    text = {r["label"]: r["value"] for r in C.summary(C.catalog(c)).collect()}
    assert text["RA"] == "20.5" and text["Binning"] == "2x1"


def test_working_set_keeps_order(spark):
    schema = "path string, ord bigint"
    old = spark.createDataFrame([("a", 0), ("b", 1)], schema)
    new = spark.createDataFrame([("c", 0), ("b", 1), ("d", 2), ("c", 3)], schema)
    got = C.add_paths(old, new).orderBy("ord").collect()
    assert [(r["path"], r["added"]) for r in got] == [("a", False), ("b", False), ("c", True), ("d", True)]
    empty = C.add_paths(old.limit(0), new).orderBy("ord").collect()
    assert [r["path"] for r in empty] == ["c", "b", "d"]


def test_hashes_depend_on_order_and_span_blocks(spark):
    schema = "frame_id string, ord int, name string, value string"
    rows = [(f, i, f"K{i}", str(i)) for f in ("a", "b") for i in range(600)]
    swapped = [("c", i, *(("K1", "1") if i == 599 else ("K599", "599") if i == 1 else (f"K{i}", str(i)))) for i in range(600)]
    got = {r["frame_id"]: r["sha256"] for r in C.header_hash(spark.createDataFrame(rows + swapped, schema)).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_pixel_hash_is_over_stored_bytes(spark, frame):
    ramp = np.arange(12.0).reshape(3, 4)
    cases = {1: ("I16", ">i2"), 2: ("U8", ">u1"), 3: ("F32", ">f4"), 4: ("F64", ">f8"), 5: ("I32", ">i4")}
    lines = [frame(ramp.tolist(), sample_type=kind, frame_id=k) for k, (kind, _) in cases.items()]
    df = reduce(DataFrame.unionByName, lines)
    got = {r["frame_id"]: r["sha256"] for r in C.pixel_hash(df.orderBy(F.desc("y"))).collect()}
    for k, (_, stored) in cases.items():
        digests = "".join(hashlib.sha256(row.astype(stored).tobytes()).hexdigest() for row in ramp)
        block = hashlib.sha256(digests.encode()).hexdigest()
        assert got[k] == hashlib.sha256(block.encode()).hexdigest()
    plan = C.pixel_hash(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(lambda" not in plan
