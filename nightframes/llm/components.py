"""Connected components by alternating star steps; edges stay in tables, whatever a node's degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightframes.llm.tables import staged


def large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def roots(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node with an edge other than to itself; the root is the smallest node."""

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = staged(edges.select("a", "b").filter("a <> b"), name)
    before = None
    while True:
        edges = staged(small_star(large_star(edges)), name)
        now = state(edges)
        if now == before:
            break
        before = now
    smallest = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(smallest)
