"""The stored result table: buckets touched, repeated batches, compaction."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from nightframes.operators import incremental as N
from nightframes.operators import result_cache as R
from nightframes.session import staged


def targets_of(spark, rows):
    return staged(spark.createDataFrame(rows, "path string, length bigint, stamp bigint"), "targets")


def analyze(work):
    status = F.when(F.col("path").endswith("bad"), N.ERROR).otherwise(N.ANALYZED)
    return work.withColumns({"status": status, "stars_measured": F.lit(False), "mean": F.col("length") * 1.5})


def stored(spark, folder):
    return sorted((r["path"], r["length"], r["stamp"], r["mean"]) for r in R.read_results(spark, folder).collect())


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 8)


def test_a_batch_touches_only_its_buckets(spark, tmp_path, few_buckets):
    folder = str(tmp_path / "cache")
    assert R.read_results(spark, folder) is None
    first = targets_of(spark, [(f"p{i}", i, 1) for i in range(40)])
    assert R.answer_batch(first, folder, 0, analyze) == list(range(8))
    before = {d: os.listdir(f"{folder}/{d}") for d in os.listdir(folder) if d.startswith("bucket")}
    one = targets_of(spark, [("p3", 99, 2)])
    (bucket,) = R.answer_batch(one, folder, 1, analyze)
    after = {d: os.listdir(f"{folder}/{d}") for d in os.listdir(folder) if d.startswith("bucket")}
    assert {d for d in after if after[d] != before[d]} == {f"bucket={bucket}"}
    read = R.read_results(spark, folder, [bucket])
    assert all(f"/bucket={bucket}/" in f for f in read.inputFiles())
    assert dict((p, n) for p, n, *_ in stored(spark, folder))["p3"] == 99 and len(stored(spark, folder)) == 40


def test_a_repeated_batch_changes_nothing(spark, tmp_path, few_buckets):
    folder, asked = str(tmp_path / "cache"), []

    def counted(work):
        asked.append(sorted(r["path"] for r in work.collect()))
        return analyze(work)

    R.answer_batch(targets_of(spark, [("a", 1, 1), ("b", 2, 1), ("c-bad", 3, 1)]), folder, 0, counted)
    second = targets_of(spark, [("a", 1, 1), ("b", 2, 7), ("c-bad", 3, 1)])
    R.answer_batch(second, folder, 1, counted)
    once = stored(spark, folder)
    R.answer_batch(second, folder, 1, counted)
    assert stored(spark, folder) == once == [("a", 1, 1, 1.5), ("b", 2, 7, 3.0)]
    # unchanged results are not asked for again, errors are
    assert asked[1] == asked[2] == ["b", "c-bad"]
    assert R.answer_batch(targets_of(spark, []), folder, 2, counted) == []


def test_many_versions_become_one(spark, tmp_path, few_buckets, monkeypatch):
    monkeypatch.setattr(R, "MOST_VERSIONS", 2)
    monkeypatch.setattr(R, "BUCKETS", 1)
    folder = str(tmp_path / "cache")
    for batch in range(5):
        R.answer_batch(targets_of(spark, [("same", batch, batch), (f"own{batch}", batch, 0)]), folder, batch, analyze)
    assert len(R.versions(spark, folder, 0)) <= 3
    want = [*((f"own{b}", b, 0, b * 1.5) for b in range(5)), ("same", 4, 4, 6.0)]
    assert stored(spark, folder) == want
    # the last batch once more, after its predecessors were put together
    R.answer_batch(targets_of(spark, [("same", 4, 4), ("own4", 4, 0)]), folder, 4, analyze)
    assert stored(spark, folder) == want
    monkeypatch.setattr(R, "MOST_VERSIONS", 1)
    assert R.compact(spark, folder, [0], 5) == [0] and R.versions(spark, folder, 0) == [4]
    assert stored(spark, folder) == want
