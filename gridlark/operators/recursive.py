"""Recursive queries past the engine's depth limit: fixpoints by deltas, and trees by doubling.

``WITH RECURSIVE`` unrolls a query level by level and stops at a fixed number of levels. ``fixpoint`` goes
on until nothing new is found and joins the newest rows only; ``hierarchy`` doubles the length of its
pointers in every round, so that a path of ten thousand steps takes fifteen rounds. Every round is written
to the shared folder: lineage stays short, and a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.sources.scratch import scratch_path

MOST_ROUNDS = 10_000


def _same(keys: Sequence[str], left: str, right: str) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return found


def fixpoint(
    start: DataFrame,
    step: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """``start`` and all that ``step`` leads to from it, one row for each value of ``keys``.

    ``step`` gets the rows that were new in the round before and returns rows of the same columns. Rows
    whose keys are known are dropped, so cycles end. Of several new rows of one key that a round finds,
    the smallest stays, by the order of the columns. More than ``most_rounds`` rounds are an error.
    """
    spark, path = start.sparkSession, scratch_path(start.sparkSession, "fixpoint")
    columns = start.columns
    rest = [c for c in columns if c not in keys]

    def unique(rows: DataFrame) -> DataFrame:
        if not rest:
            return rows.select(*columns).distinct()
        one = F.min(F.struct(*rest)).alias("_row")
        return rows.groupBy(*keys).agg(one).select(*keys, "_row.*").select(*columns)

    unique(start).write.parquet(f"{path}/round=0")
    for number in range(1, most_rounds + 1):
        known = spark.read.schema(start.schema).parquet(*[f"{path}/round={n}" for n in range(number)])
        newest = spark.read.schema(start.schema).parquet(f"{path}/round={number - 1}")
        if newest.isEmpty():
            return known
        found = unique(step(newest)).alias("found")
        fresh = found.join(known.select(*keys).alias("known"), _same(keys, "found", "known"), "left_anti")
        fresh.select(*columns).write.parquet(f"{path}/round={number}")
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Root and depth of every node, from rows of node and parent: node, root, depth.

    A node whose parent is null or no node is a root, of depth 0. Nodes on a cycle, or below one, have no
    root: both are null. Every node has one row; a repeated one keeps its smallest parent. Only nodes that
    have not reached their root are joined, so the many that point to a root meet in no task.
    """
    spark, path = links.sparkSession, scratch_path(links.sparkSession, "hierarchy")
    rows = links.filter(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    rows.write.parquet(f"{path}/links")
    rows = spark.read.parquet(f"{path}/links")
    there = rows.select(F.col("node").alias("known"))
    # A pointer: a node above, how many steps up it is, and whether it is a root.
    pointed = rows.join(there, F.col("up") == F.col("known"), "left")
    is_root = F.col("known").isNull()
    pointers = pointed.select(
        "node",
        F.when(is_root, F.col("node")).otherwise(F.col("up")).alias("up"),
        F.when(is_root, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("steps"),
        is_root.alias("done"),
    )
    pointers.write.parquet(f"{path}/0")
    pointers = spark.read.parquet(f"{path}/0")
    # A path has fewer steps than there are nodes; what is open after that many doublings has no root.
    rounds = pointers.count().bit_length() + 1
    finished = [f"{path}/0"]
    for number in range(1, rounds + 1):
        open_ = pointers.filter(~F.col("done"))
        if open_.isEmpty():
            break
        above = spark.read.parquet(*finished).filter("done").select(
            F.col("node").alias("of"), F.col("up").alias("to"), F.col("steps").alias("more"), F.lit(True).alias("end")
        )
        further = open_.select(
            F.col("node").alias("of"), F.col("up").alias("to"), F.col("steps").alias("more"), F.lit(False).alias("end")
        )
        moved = open_.join(above.unionByName(further), F.col("up") == F.col("of"))
        moved.select(
            "node", F.col("to").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done")
        ).write.parquet(f"{path}/{number}")
        finished.append(f"{path}/{number}")
        pointers = spark.read.parquet(f"{path}/{number}")
    ended = spark.read.parquet(*finished).filter("done").select("node", F.col("up").alias("root"), F.col("steps").alias("depth"))
    lost = pointers.filter(~F.col("done")).select("node", F.lit(None).cast(rows.schema["node"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"))
    return ended.unionByName(lost)
