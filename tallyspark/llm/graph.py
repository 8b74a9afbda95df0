"""Connected components of an edge table, by stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut


def _stars(state: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or none but larger ones."""
    ends = state.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        state.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that
    it reaches. Edges are undirected; loops and repeats don't matter.

    Alternates large-star and small-star steps (each a minimum per node and a
    join) until every component is a star around its smallest node. A node's neighbours are never gathered in one
    row; the minimum is combined before the shuffle, and both sides of each
    join are plain exchanges of written tables, which adaptive execution
    splits when a centre is hot.
    """
    state = cut(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    while not _stars(state):
        # Large star: every larger neighbour is tied to the node's smallest one.
        both = state.unionByName(state.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = cut(both.groupBy("hi").agg(F.min("lo").alias("m")).select(
            F.col("hi").alias("n"), F.least("hi", "m").alias("m")))
        large = cut(both.join(least, F.col("hi") == F.col("n")).filter(F.col("lo") > F.col("n")).select(
            F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo"))
        # Small star: every smaller neighbour, and the node, to the smallest.
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "n"))
        state = cut(large.join(least, F.col("hi") == F.col("n")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                    .union(least.select("n", "m")).filter("hi <> lo").distinct())
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        state.select(F.col("lo"), F.col("lo")).distinct())
