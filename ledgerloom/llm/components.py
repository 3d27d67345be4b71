"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregate with map-side combine and an equi join, so a node with very many edges is combined before it is moved, and AQE
may split its join. Rounds grow with the logarithm of the longest path. Edges are cut to the shared folder after each round, and those of
the round before are deleted.

Defined cases: an empty table of edges has no nodes; loops and repeated edges count for nothing; a null end makes no edge; other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(lowest, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Has each node one edge, to a node that has none?"""
    several = edges.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")).where("least <> most")
    chained = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return not several.limit(1).count() and not chained.limit(1).count()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) of long ids -> (node, root) for each node with an edge to another node; root is one of the component's ids, the same for all.
    Edges that are stars already, as most callers' are, take no round."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not _is_forest(edges):
        last, edges = edges, cut(_star(_star(edges, True), False), "edges")
        drop(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
