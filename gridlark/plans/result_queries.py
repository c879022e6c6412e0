"""Queries over results: capped, saved, described, made safe, shown as text or JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.values import exact_integers, grid_text, json_rows, sanitize, unsafe_integer
from gridlark.operators.inspect import column_profile, grid_columns
from gridlark.operators.results import (
    cap_rows,
    drop_results,
    load_result,
    non_blank,
    result_name,
    result_schema,
    save_result,
)
from gridlark.plans.query import Query
from gridlark.sources.scratch import scratch_namespace
from gridlark.sources.tables import table

TOP_LINES = ["l_extendedprice DESC", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def by(*keys: str) -> list:
    """``"x DESC"`` and ``"x"`` as sort columns."""
    return [F.desc(k.split()[0]) if k.endswith(" DESC") else F.asc(k) for k in keys]


def top_lines(spark: SparkSession, folder: str) -> DataFrame:
    return cap_rows(table(spark, folder, "lineitem").select(*LINE_COLUMNS), order_by=by(*TOP_LINES))


TOP_LINES_SQL = f"SELECT {', '.join(LINE_COLUMNS)} FROM lineitem ORDER BY {', '.join(TOP_LINES)} LIMIT 1000"


def result_count(spark: SparkSession, folder: str) -> DataFrame:
    return top_lines(spark, folder).agg(F.count(F.lit(1)).alias("rows"))


def fresh_id(label: str) -> str:
    return f"{label}-{uuid.uuid4().hex[:12]}"


TOP_ORDERS = ["o_totalprice DESC", "o_orderkey"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


def result_saved(spark: SparkSession, folder: str) -> DataFrame:
    namespace, job = scratch_namespace(spark), fresh_id("saved")
    orders = table(spark, folder, "orders").select(*ORDER_COLUMNS)
    # Saved twice: the second save replaces the first.
    save_result(orders, job, namespace, order_by=by("o_orderkey"))
    save_result(orders, job, namespace, order_by=by(*TOP_ORDERS))
    return load_result(spark, job, namespace, order_by=by(*TOP_ORDERS))


RESULT_SAVED = f"SELECT {', '.join(ORDER_COLUMNS)} FROM orders ORDER BY {', '.join(TOP_ORDERS)} LIMIT 1000"


def result_dropped(spark: SparkSession, folder: str) -> DataFrame:
    """One result per order priority is saved; those of priorities with few urgent totals are dropped.

    The ids to drop are rows of the data, among them some that never had a result. What is left is read
    back.
    """
    namespace, batch = scratch_namespace(spark), uuid.uuid4().hex[:12]
    orders = table(spark, folder, "orders").select(*ORDER_COLUMNS)
    job = F.concat(F.lit(f"{batch}-"), F.substring("o_orderpriority", 1, 1))
    for digit in "12345":
        rows = orders.where(F.col("o_orderpriority").startswith(digit))
        save_result(rows, f"{batch}-{digit}", namespace, n=100, order_by=by(*TOP_ORDERS))
    # Each customer key stands for a job that never ran.
    gone = orders.where(F.col("o_orderpriority") > "3").select(job.alias("id")).unionByName(
        orders.select(F.concat(F.lit(f"{batch}-none-"), "o_custkey").alias("id"))
    )
    failed = drop_results(spark, gone, namespace)
    there = [d for d in "12345" if spark.catalog.tableExists(result_name(f"{batch}-{d}", namespace))]
    kept = load_result(spark, f"{batch}-{there[0]}", namespace)
    for digit in there[1:]:
        kept = kept.unionByName(load_result(spark, f"{batch}-{digit}", namespace))
    return kept.select("o_orderkey", "o_orderpriority", F.lit(failed).alias("failed"))


RESULT_DROPPED = """
    SELECT o_orderkey, o_orderpriority, CAST(0 AS INTEGER) AS failed
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    WHERE r <= 100 AND o_orderpriority <= '3'
"""


def result_schema_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of a result with the number of values each holds."""
    orders = table(spark, folder, "orders")
    values = column_profile(orders).select("pos", (F.col("value_count") - F.col("null_count")).alias("values"))
    return result_schema(orders).join(values, "pos").select("pos", "name", "type", "values")


ORDERS_FIELDS = [
    ("o_orderkey", "LongType()"),
    ("o_custkey", "LongType()"),
    ("o_orderstatus", "StringType()"),
    ("o_totalprice", "DoubleType()"),
    ("o_orderdate", "TimestampNTZType()"),
    ("o_orderpriority", "StringType()"),
]
RESULT_SCHEMA = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS pos, '{name}' AS name, '{kind}' AS type, count({name}) AS values FROM orders"
    for i, (name, kind) in enumerate(ORDERS_FIELDS)
)


def sanitize_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Binary at several depths; documents with an even number are no valid UTF-8."""
    raw = F.col("text").cast("binary")
    payload = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FFFE")), raw)).otherwise(raw)
    docs = table(spark, folder, "documents").select(
        "doc_id",
        payload.alias("flat"),
        F.array(payload, raw).alias("listed"),
        F.struct(F.col("lang"), F.struct(payload.alias("deep")).alias("inner")).alias("held"),
        F.create_map(F.col("doc_id"), payload).alias("mapped"),
        F.when(F.col("lang") == "en", F.struct(payload.alias("deep"))).alias("absent"),
    )
    safe = sanitize(docs)
    return safe.select(
        "doc_id",
        F.col("flat"),
        F.md5(F.col("listed")[0]).alias("first"),
        F.md5(F.col("listed")[1]).alias("second"),
        F.md5("held.inner.deep").alias("deep"),
        F.map_keys("mapped")[0].alias("key"),
        F.md5(F.map_values("mapped")[0]).alias("value"),
        F.col("absent").isNull().alias("no_struct"),
    )


SANITIZE_BINARY = """
    WITH docs AS (
        SELECT doc_id, lang, text, CASE WHEN doc_id % 2 = 0
               THEN base64('\\xFF\\xFE'::BLOB || encode(text)) ELSE text END AS flat FROM documents
    )
    SELECT doc_id, flat, md5(flat) AS first, md5(text) AS second, md5(flat) AS deep,
           CAST(doc_id AS VARCHAR) AS key, md5(flat) AS value, coalesce(lang <> 'en', TRUE) AS no_struct
    FROM docs
"""


def nested_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls and nested columns."""
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_totalprice") > 200000).alias("big"),
        F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("rank")).alias("customer"),
        F.array(F.year("o_orderdate"), F.month("o_orderdate")).alias("month"),
        F.create_map(F.lit("p"), F.col("o_orderpriority")).alias("tags"),
    )


NESTED_PARTS = """
    json_object('id', o_custkey, 'rank', o_orderpriority) AS customer,
    json_array(year(o_orderdate), month(o_orderdate)) AS month,
    json_object('p', o_orderpriority) AS tags
"""
GRID_ORDERS = f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '') AS status,
           regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price,
           CAST(o_totalprice > 200000 AS VARCHAR) AS big,
           CAST(customer AS VARCHAR) AS customer, CAST(month AS VARCHAR) AS month, CAST(tags AS VARCHAR) AS tags
    FROM (SELECT *, {NESTED_PARTS} FROM orders)
"""
JSON_ORDERS = f"""
    SELECT CAST(json_object('o_orderkey', o_orderkey, 'status', nullif(o_orderstatus, 'F'), 'price', o_totalprice,
                            'big', o_totalprice > 200000, 'customer', customer, 'month', month, 'tags', tags)
                AS VARCHAR) AS json
    FROM (SELECT *, {NESTED_PARTS} FROM orders)
"""


def exact_int_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey").cast("decimal(20,0)") * F.lit(10**16).cast("decimal(17,0)")).alias("wide")
    )
    flagged = orders.withColumn("unsafe", unsafe_integer(F.col("wide")))
    return exact_integers(flagged)


EXACT_INT_ORDERS = """
    SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
           CAST(CAST(o_orderkey AS DECIMAL(20,0)) * CAST(10000000000000000 AS DECIMAL(17,0)) AS VARCHAR) AS wide,
           o_orderkey > 0 AS unsafe
    FROM orders
"""


def non_blank_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, and for each a text of white space alone that depends on its language."""
    docs = table(spark, folder, "documents")
    blank = (
        F.when(F.col("lang") == "en", "")
        .when(F.col("lang") == "de", "  ")
        .when(F.col("lang") == "fr", "\t\n\r")
        .otherwise("  ")
    )
    both = docs.select("doc_id", "text").unionByName(docs.select("doc_id", blank.alias("text")))
    return non_blank(both, "text").select("doc_id", F.md5("text").alias("digest"))


NON_BLANK_DOCS = "SELECT doc_id, md5(text) AS digest FROM documents WHERE regexp_matches(text, '\\S')"


def grid_columns_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = nested_orders(spark, folder).withColumn("wide", F.col("o_orderkey") + F.lit(9007199254740992))
    return grid_columns(orders, by("price DESC", "o_orderkey"))


GRID_COLUMNS = """
    WITH first AS (SELECT nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
    SELECT CAST(pos AS INTEGER) AS pos, name,
           CASE WHEN name = 'status' AND (SELECT status FROM first) IS NULL THEN 'object' ELSE type END AS type
    FROM (VALUES (0, 'o_orderkey', 'number'), (1, 'status', 'string'), (2, 'price', 'number'),
                 (3, 'big', 'boolean'), (4, 'customer', 'object'), (5, 'month', 'object'),
                 (6, 'tags', 'object'), (7, 'wide', 'string')) t(pos, name, type)
"""

QUERIES = {
    "result_capped": Query(top_lines, TOP_LINES_SQL),
    "result_count": Query(result_count, f"SELECT count(*) AS rows FROM ({TOP_LINES_SQL})"),
    "result_saved": Query(result_saved, RESULT_SAVED),
    "result_dropped": Query(result_dropped, RESULT_DROPPED),
    "result_schema_orders": Query(result_schema_orders, RESULT_SCHEMA),
    "sanitize_binary": Query(sanitize_binary, SANITIZE_BINARY),
    "grid_orders": Query(lambda spark, folder: grid_text(nested_orders(spark, folder)), GRID_ORDERS),
    "json_orders": Query(lambda spark, folder: json_rows(nested_orders(spark, folder)), JSON_ORDERS),
    "exact_int_orders": Query(exact_int_orders, EXACT_INT_ORDERS),
    "non_blank_docs": Query(non_blank_docs, NON_BLANK_DOCS),
    "grid_columns_orders": Query(grid_columns_orders, GRID_COLUMNS),
}
