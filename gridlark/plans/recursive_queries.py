"""Recursive queries of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.ordered import look_back, neighbours
from gridlark.operators.recursive import fixpoint, hierarchy
from gridlark.plans.query import Query
from gridlark.sources.tables import table


def chains_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Each order points to the one of its priority before it: a few chains of a fifth of all orders.

    The first order of a chain and how far each is from it, without walking step by step.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    before = neighbours(orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], {"parent": look_back("o_orderkey")})
    found = hierarchy(before.select(F.col("o_orderkey").alias("node"), "parent"))
    return found.select(F.col("node").alias("o_orderkey"), "root", "depth")


CHAINS_ORDERS = """
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)
"""


def walk_customers(spark: SparkSession, folder: str) -> DataFrame:
    """From the regions down to every customer, and on to a customer's orders of the highest total."""
    region = table(spark, folder, "region").select(F.lit("world").alias("above"), F.concat(F.lit("r"), "r_regionkey").alias("below"))
    nation = table(spark, folder, "nation").select(
        F.concat(F.lit("r"), "n_regionkey").alias("above"), F.concat(F.lit("n"), "n_nationkey").alias("below")
    )
    customer = table(spark, folder, "customer").select(
        F.concat(F.lit("n"), "c_nationkey").alias("above"), F.concat(F.lit("c"), "c_custkey").alias("below")
    )
    order = table(spark, folder, "orders").filter("o_totalprice > 300000").select(
        F.concat(F.lit("c"), "o_custkey").alias("above"), F.concat(F.lit("o"), "o_orderkey").alias("below")
    )
    edges = region.unionByName(nation).unionByName(customer).unionByName(order)
    start = spark.range(1).select(F.lit("world").alias("node"), F.lit(0).alias("depth"))

    def step(newest: DataFrame) -> DataFrame:
        return newest.join(edges, F.col("node") == F.col("above")).select(
            F.col("below").alias("node"), (F.col("depth") + 1).alias("depth")
        )

    return fixpoint(start, step, ["node"])


WALK_CUSTOMERS = """
    WITH RECURSIVE edges AS (
        SELECT 'world' AS above, 'r' || r_regionkey AS below FROM region
        UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders WHERE o_totalprice > 300000
    ), walk(node, depth) AS (
        SELECT 'world', 0 UNION ALL SELECT below, depth + 1 FROM walk JOIN edges ON node = above
    )
    SELECT node, CAST(depth AS INTEGER) AS depth FROM walk
"""

QUERIES = {
    "chains_orders": Query(chains_orders, CHAINS_ORDERS),
    "walk_customers": Query(walk_customers, WALK_CUSTOMERS),
}
