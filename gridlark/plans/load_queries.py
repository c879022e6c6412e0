"""Loading queries: tables are created and filled in scratch space, then read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.results import run_query
from gridlark.plans.query import Query
from gridlark.sources.merge import delete_rows, merge_rows
from gridlark.sources.scratch import scratch_namespace
from gridlark.sources.seed import ensure_namespace, ip_rows, seed_table
from gridlark.sources.tables import attach, table


def fresh_table(spark: SparkSession, label: str) -> str:
    return f"{scratch_namespace(spark)}.{label}_{uuid.uuid4().hex[:12]}"


# Fixed value: schema of the nested activity log.
LOG_DDL = "log_id LONG, event STRUCT<name: STRING, context: STRUCT<ip: STRING, browser: STRING>>, log_date DATE"

CUSTOMER_DDL = "c_custkey BIGINT, c_name STRING, c_mktsegment STRING"


def seed_twice(spark: SparkSession, folder: str) -> DataFrame:
    """The second seeding finds rows and writes nothing."""
    name = fresh_table(spark, "customers")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    wrote = [seed_table(spark, name, CUSTOMER_DDL, customers) for _ in range(2)]
    return spark.table(name).select("*", F.lit(wrote[0]).alias("first"), F.lit(wrote[1]).alias("second"))


def seed_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    name = fresh_table(spark, "orders_by_year")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr")
    )
    seed_table(spark, name, "o_orderkey BIGINT, o_totalprice DOUBLE, yr INT", orders, ["yr"])
    return spark.table(name).where("yr >= 1997").groupBy("yr").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("top")
    )


def nested_select(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log with two levels of structs, partitioned by day, read back field by field."""
    name = fresh_table(spark, "logs")
    context = F.struct(
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"),
        F.get_json_object("props", "$.k").alias("browser"),
    )
    rows = table(spark, folder, "events").select(
        F.col("event_id").alias("log_id"),
        F.struct(F.col("event_type").alias("name"), context.alias("context")).alias("event"),
        F.to_date("ts").alias("log_date"),
    )
    seed_table(spark, name, LOG_DDL, rows, ["log_date"])
    return run_query(
        spark,
        f"""
        SELECT log_id, event.name AS name, event.context.ip AS ip, event.context.browser AS browser,
               date_format(log_date, 'yyyy-MM-dd') AS log_date
        FROM {name}
        """,
    )


NESTED_SELECT = """
    SELECT event_id AS log_id, event_type AS name, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS ip,
           json_extract_string(props, '$.k') AS browser, strftime(ts, '%Y-%m-%d') AS log_date
    FROM events
"""


def ipgeo_by_country(spark: SparkSession, folder: str) -> DataFrame:
    rows = ip_rows(table(spark, folder, "customer"), "c_custkey")
    return rows.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ip").alias("ips"), F.max("id").alias("last_id")
    )


IPGEO = """
    SELECT 'Country_' || CAST(c_custkey % 10 AS VARCHAR) AS country, count(*) AS n,
           count(DISTINCT '192.168.1.' || CAST(c_custkey % 255 AS VARCHAR)) AS ips,
           max(c_custkey) AS last_id
    FROM customer GROUP BY 1
"""


def namespace_made(spark: SparkSession, folder: str) -> DataFrame:
    """A namespace is made twice and then holds a table; a bad name is reported, not raised."""
    namespace = scratch_namespace(spark, f"gridlark_ns_{uuid.uuid4().hex[:12]}")
    again = ensure_namespace(spark, namespace)
    bad = ensure_namespace(spark, "no_such_catalog.inner.deep")
    name = f"{namespace}.suppliers"
    seed_table(spark, name, "s_suppkey BIGINT, s_name STRING", table(spark, folder, "supplier").select("s_suppkey", "s_name"))
    return spark.table(name).select("*", F.lit(again).alias("again"), F.lit(bad).alias("bad"))


def sink_table(spark: SparkSession, folder: str) -> DataFrame:
    """A table made by a query, then appended to."""
    name = fresh_table(spark, "sink")
    attach(spark, folder, ["orders"])
    run_query(
        spark,
        f"""
        CREATE TABLE {name} USING parquet AS
        SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
        """,
    )
    run_query(spark, f"INSERT INTO {name} SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'P'")
    return spark.table(name)


SINK_TABLE = """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE o_orderstatus = 'P'
"""


def sink_merge(spark: SparkSession, folder: str) -> DataFrame:
    """An upsert and a delete on a Parquet table; only files that hold a changed customer are rewritten.

    Changes are reduced to one row per customer before, so no key is hot.
    """
    name = fresh_table(spark, "balances")
    attach(spark, folder, ["customer", "orders"])
    run_query(
        spark,
        f"""
        CREATE TABLE {name} USING parquet AS
        SELECT c_custkey AS custkey, c_acctbal AS balance FROM customer WHERE c_acctbal < 5000
        """,
    )
    changes = run_query(
        spark,
        """
        SELECT o_custkey AS custkey, max(o_totalprice) AS balance FROM orders
        WHERE o_totalprice > 350000 GROUP BY o_custkey
        """,
    )
    merge_rows(spark, name, changes, ["custkey"], delete_when=F.col("balance") >= 450000)
    return spark.table(name)


def sink_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Rows removed from a table partitioned by year; other years keep their files."""
    name = fresh_table(spark, "kept_orders")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("yr"))
    seed_table(spark, name, "o_orderkey BIGINT, o_orderstatus STRING, yr INT", orders, ["yr"])
    delete_rows(spark, name, (F.col("o_orderstatus") == "F") & (F.col("yr") >= 1994))
    return spark.table(name).groupBy("yr").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last")
    )


SINK_DELETE = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS orders, max(o_orderkey) AS last
    FROM orders WHERE NOT (o_orderstatus = 'F' AND year(o_orderdate) >= 1994) GROUP BY 1
"""


SINK_MERGE = """
    WITH old AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000),
         changes AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders
                     WHERE o_totalprice > 350000 GROUP BY o_custkey)
    SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(top, c_acctbal) AS balance
    FROM old FULL OUTER JOIN changes ON c_custkey = o_custkey WHERE coalesce(top, 0) < 450000
"""

QUERIES = {
    "seed_twice": Query(
        seed_twice, 'SELECT c_custkey, c_name, c_mktsegment, TRUE AS "first", FALSE AS "second" FROM customer'
    ),
    "seed_partitioned": Query(
        seed_partitioned,
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS orders, max(o_totalprice) AS top "
        "FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1",
    ),
    "nested_select": Query(nested_select, NESTED_SELECT),
    "ipgeo_by_country": Query(ipgeo_by_country, IPGEO),
    "namespace_made": Query(namespace_made, "SELECT s_suppkey, s_name, TRUE AS again, FALSE AS bad FROM supplier"),
    "sink_table": Query(sink_table, SINK_TABLE),
    "sink_merge": Query(sink_merge, SINK_MERGE),
    "sink_delete": Query(sink_delete, SINK_DELETE),
}
