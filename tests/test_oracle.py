"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from nightframes.plans.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def outcomes(spark):
    """Results of all queries, run a few at a time: small jobs mostly wait for the driver."""
    con = connect(SF_DIR)

    def check(item):
        name, fn = item
        return name, difference(fn(spark, SF_DIR), con.cursor(), ORACLES[name])

    with ThreadPoolExecutor(6) as pool:
        futures = [pool.submit(check, item) for item in QUERIES.items()]
        results = {}
        for name, future in zip(QUERIES, futures):
            try:
                results[name] = future.result()[1]
            except Exception as error:
                results[name] = repr(error)
        return results


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(outcomes, name):
    assert outcomes[name] is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
