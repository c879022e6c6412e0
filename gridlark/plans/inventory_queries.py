"""Inventory queries. The inventory is derived from ``part``: brand, type and name are the levels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.text import full_name
from gridlark.operators.inventory import list_catalogs, list_items, list_namespaces, safe_names, search
from gridlark.plans.query import Query
from gridlark.sources.catalog import load_inventory
from gridlark.sources.scratch import scratch_namespace
from gridlark.sources.seed import seed_table
from gridlark.sources.tables import table

CATALOG, NAMESPACE = "Brand#13", "ECONOMY"


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as tables, and those of certain sizes as views too."""
    items = table(spark, folder, "part").select(
        F.col("p_brand").alias("catalog"),
        F.col("p_type").alias("namespace"),
        F.col("p_name").alias("name"),
        F.explode(F.when(F.col("p_size") % 5 == 0, F.array(F.lit("table"), F.lit("view"))).otherwise(
            F.array(F.lit("table"))
        )).alias("type"),
        F.lit(False).alias("is_temporary"),
    )
    return items


TYPED = "CASE WHEN max(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END) = 1 THEN 'view' ELSE 'table' END"
ITEMS = f"""
    SELECT p_brand AS catalog, p_type AS namespace, p_name AS name, {TYPED} AS type
    FROM part GROUP BY p_brand, p_type, p_name
"""


def search_sql(text: str) -> str:
    """Literal, case-insensitive search over the three levels."""
    hit = f"contains(lower({{}}), lower('{text}'))"
    none = "CAST(NULL AS VARCHAR)"
    return f"""
        SELECT DISTINCT 'catalog' AS type, p_brand AS catalog, {none} AS namespace, {none} AS "table",
               p_brand AS name FROM part WHERE {hit.format('p_brand')}
        UNION ALL
        SELECT DISTINCT 'namespace', p_brand, p_type, {none}, p_type FROM part WHERE {hit.format('p_type')}
        UNION ALL
        SELECT type, catalog, namespace, name, name FROM ({ITEMS}) WHERE {hit.format('name')}
    """


def searched(text: str) -> Query:
    return Query(lambda spark, folder: search(inventory(spark, folder), text), search_sql(text))


def marked_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The same items; some names hold an underscore, some a percent sign."""
    size, name = F.col("size"), F.col("name")
    part = table(spark, folder, "part").select(
        F.col("p_brand").alias("catalog"), F.col("p_type").alias("namespace"), F.col("p_name").alias("name"),
        F.col("p_size").alias("size"),
    )
    marked = F.when(size % 7 == 0, F.replace(name, F.lit(" "), F.lit("_"))).when(size % 11 == 0, F.concat(name, F.lit("%")))
    kinds = F.when(size % 5 == 0, F.array(F.lit("table"), F.lit("view"))).otherwise(F.array(F.lit("table")))
    return part.select(
        "catalog", "namespace", F.coalesce(marked, name).alias("name"), F.explode(kinds).alias("type"),
        F.lit(False).alias("is_temporary"),
    )


def searched_literally(text: str) -> Query:
    """Signs that are wildcards elsewhere stand for themselves."""
    marked = """
        WITH marked AS (
            SELECT * REPLACE (CASE WHEN p_size % 7 = 0 THEN replace(p_name, ' ', '_')
                                   WHEN p_size % 11 = 0 THEN p_name || '%' ELSE p_name END AS p_name) FROM part)
    """
    sql = marked + search_sql(text).replace("FROM part", "FROM marked")
    return Query(lambda spark, folder: search(marked_inventory(spark, folder), text), sql)


def names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    marked = F.concat("p_name", F.lit("\n"))
    return part.select(
        F.explode(
            F.array("p_type", "p_name", F.replace("p_name", F.lit(" "), F.lit("_")), marked)
        ).alias("name")
    ).distinct()


NAMES = """
    SELECT p_type AS name FROM part UNION SELECT p_name FROM part
    UNION SELECT replace(p_name, ' ', '_') FROM part UNION SELECT p_name || chr(10) FROM part
"""
VALID = "regexp_full_match({}, '[a-zA-Z0-9_.]+')"


def full_names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    catalog = F.when(F.col("p_size") > 25, F.replace("p_brand", F.lit("#"), F.lit("_"))).otherwise(F.col("p_brand"))
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    return part.select("p_partkey", full_name(catalog, F.col("p_type"), name).alias("full_name"))


FULL_NAMES = f"""
    WITH named AS (
        SELECT p_partkey, p_type, replace(p_name, ' ', '.') AS name,
               CASE WHEN p_size > 25 THEN replace(p_brand, '#', '_') ELSE p_brand END AS catalog FROM part
    )
    SELECT p_partkey, CASE WHEN {VALID.format('catalog')} AND {VALID.format('p_type')} AND {VALID.format('name')}
                           THEN catalog || '.' || p_type || '.' || name END AS full_name
    FROM named
"""


def inv_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Tables and a view are made from the orders; the loader finds them; each is counted."""
    namespace = scratch_namespace(spark, f"gridlark_inv_{uuid.uuid4().hex[:12]}")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    ddl = "o_orderkey BIGINT, o_orderstatus STRING"
    seed_table(spark, f"{namespace}.all_orders", ddl, orders)
    seed_table(spark, f"{namespace}.done_orders", ddl, orders.where("o_orderstatus = 'F'"))
    spark.sql(
        f"CREATE VIEW {namespace}.open_orders AS SELECT * FROM {namespace}.all_orders WHERE o_orderstatus = 'O'"
    )
    found = load_inventory(spark)
    items = list_items(found, "spark_catalog", namespace)
    counts = None
    for name in ("all_orders", "done_orders", "open_orders"):
        rows = spark.table(f"{namespace}.{name}").agg(F.count(F.lit(1)).alias("rows"))
        rows = rows.withColumn("name", F.lit(name))
        counts = rows if counts is None else counts.unionByName(rows)
    return items.join(counts, "name", "left").select("name", "type", "rows")


INV_LOADED = """
    SELECT 'all_orders' AS name, 'table' AS type, count(*) AS rows FROM orders
    UNION ALL SELECT 'done_orders', 'table', count(*) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'open_orders', 'view', count(*) FROM orders WHERE o_orderstatus = 'O'
"""

QUERIES = {
    "inv_catalogs": Query(
        lambda spark, folder: list_catalogs(inventory(spark, folder)), "SELECT DISTINCT p_brand AS catalog FROM part"
    ),
    "inv_namespaces": Query(
        lambda spark, folder: list_namespaces(inventory(spark, folder), CATALOG),
        f"SELECT DISTINCT p_type AS namespace FROM part WHERE p_brand = '{CATALOG}'",
    ),
    "inv_items": Query(
        lambda spark, folder: list_items(inventory(spark, folder), CATALOG, NAMESPACE),
        f"SELECT name, type FROM ({ITEMS}) WHERE catalog = '{CATALOG}' AND namespace = '{NAMESPACE}'",
    ),
    "inv_search": searched("o"),
    "inv_search_catalogs": searched("bRaNd#1"),
    "inv_search_wildcard": searched_literally("%"),
    "inv_search_underscore": searched_literally("_"),
    "inv_search_all": searched(""),
    "inv_loaded": Query(inv_loaded, INV_LOADED),
    "valid_names": Query(
        lambda spark, folder: safe_names(names(spark, folder), "name"),
        f"SELECT name, {VALID.format('name')} AS valid FROM ({NAMES})",
    ),
    "full_names": Query(full_names, FULL_NAMES),
}
