"""Registered queries: SQL where there is some, and the pipeline against its operators by hand."""

from __future__ import annotations

import pytest

import corpus_pipeline
from compare import connect, difference
from nightframes.llm import jaccard_join, queries, secrets

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF_DIR).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(df.columns == names for df in seen[1:5])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[3] == ids[4] == ids[5]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    gone = {r.doc_id for r in labels.filter("toxic = 1").collect()} - ids[1]
    assert gone and not {r.doc_id for r in labels.filter("toxic = 0").collect()} - ids[1]
    # no two texts are left that are equal or linked, and no secret
    assert jaccard_join.linked_documents(seen[3]).filter("doc_id <> component_id").count() == 0
    assert secrets.find_secrets(seen[4]).filter("size(spans) > 0").count() == 0
    run = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(run.drop("sequence_id", "offset").collect()) == sorted(seen[5].drop("sequence_id", "offset").collect())
