"""Connected components of an edge table by alternating large and small stars.

Each round links every node to the smallest neighbour it knows; after a number of rounds that grows
with the logarithm of the longest path, all nodes of a component point at its smallest one. Rounds
are written to the cluster's shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.sources.scratch import scratch_path


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a, b of one type. Rows of node, component: every node that has an edge."""
    spark, path = edges.sparkSession, scratch_path(edges.sparkSession, "components")
    current = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    number = 0
    while True:
        current.write.parquet(f"{path}/{number}")
        current = spark.read.parquet(f"{path}/{number}")
        # Done when every node has one smaller neighbour at most, which has none itself.
        ends = current.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
        middle = current.select("b").distinct().join(current.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if ends.filter("least != most").select("a").union(middle).isEmpty():
            break
        number += 1
        current = _small_star(_large_star(current))
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select("b", "b").distinct())
