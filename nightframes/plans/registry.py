"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its oracle SQL if there is one."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def six(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six decimals; distributed sums depend on their order below that."""
    col = F.col(column) if isinstance(column, str) else column
    return (F.round(col, 6) + 0.0).alias(name or column)


def listed(column: str | Column, name: str | None = None) -> Column:
    """An array of whole numbers as comma-separated text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(col, lambda c: c.cast("string")), ",").alias(name or column)
