"""Connected components of an edge table by alternating large-star and small-star.

Every step is joins and aggregates over edges; nothing is gathered per component or on the
driver.  A vertex with very many edges is only a hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import written


def _larger_first(edges: DataFrame) -> DataFrame:
    return (edges.where(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a vertex to the vertex's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _larger_first(edges.join(least, edges.b == least.v).select("a", F.col("m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a vertex and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges.a == least.v).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _larger_first(moved.unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` edges -> ``node, component`` (the smallest node that it reaches) for every node
    that is not itself its component's smallest.  Loops and repeated edges are allowed."""
    edges = written(_larger_first(edges), "edges")
    mark = None
    while True:
        edges = written(small_star(large_star(edges)), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = now
