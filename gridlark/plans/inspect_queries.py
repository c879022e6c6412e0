"""Queries that look into tables: profiles, snapshots, files, partitions, headline numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.operators.inspect import (
    column_profile,
    flatten_partition,
    footer_inventory,
    parquet_files,
    partitions,
    schema_leaves,
    snapshot_log,
    snapshots,
    table_metrics,
)
from gridlark.operators.overview import table_overview
from gridlark.operators.sketches import DISTINCT_ERROR, RANK_ERROR, column_sketches, merged_sketches, sketched_profile
from gridlark.plans.load_queries import fresh_table
from gridlark.plans.query import Query
from gridlark.sources.footers import file_footers, list_files
from gridlark.sources.scratch import scratch_path
from gridlark.sources.seed import seed_table
from gridlark.sources.tables import table


def _holed() -> list:
    price = F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    return [
        F.col("o_orderkey"),
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"),
        price.alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.struct("o_custkey", F.col("o_orderpriority").alias("rank"))).alias(
            "customer"
        ),
    ]


def holed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with nulls, NaN and a struct."""
    return table(spark, folder, "orders").select(*_holed())


def profile_orders(spark: SparkSession, folder: str) -> DataFrame:
    return column_profile(holed_orders(spark, folder)).drop("nullable")


def _profile_row(pos: int, path: str, kind: str, col: str, nans: str = "CAST(NULL AS BIGINT)", bounds: str | None = None) -> str:
    low, high = "CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)"
    if bounds:
        low, high = f"CAST(min({bounds}) AS VARCHAR)", f"CAST(max({bounds}) AS VARCHAR)"
    return f"""
        SELECT CAST({pos} AS INTEGER) AS pos, '{path}' AS path, '{kind}' AS type, count(*) AS value_count,
               count(*) - count({col}) AS null_count, {nans} AS nan_count, {low} AS lower, {high} AS upper
        FROM orders
    """


KEPT = "CASE WHEN o_orderpriority <> '5-LOW' THEN {} END"
PROFILE_ORDERS = " UNION ALL ".join(
    [
        _profile_row(0, "o_orderkey", "bigint", "o_orderkey", bounds="o_orderkey"),
        _profile_row(1, "status", "string", "nullif(o_orderstatus, 'F')", bounds="nullif(o_orderstatus, 'F')"),
        _profile_row(
            2, "price", "double", "o_totalprice", "count(*) FILTER (WHERE o_orderkey % 7 = 0)",
            "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END",
        ),
        _profile_row(3, "customer", "struct<o_custkey:bigint,rank:string>", KEPT.format("1")),
        _profile_row(4, "customer.o_custkey", "bigint", KEPT.format("o_custkey"), bounds=KEPT.format("o_custkey")),
        _profile_row(5, "customer.rank", "string", KEPT.format("o_orderpriority"), bounds=KEPT.format("o_orderpriority")),
    ]
)


def profile_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A profile of all orders made of the stored sketches of each year, without reading rows again.

    Counts and bounds are exact. Estimates are held against the rows: distinct counts, and the ranks of
    medians, within the errors that the sketches keep.
    """
    path = scratch_path(spark, "sketches")
    orders = holed_orders(spark, folder)
    dated = table(spark, folder, "orders").select(F.year("o_orderdate").alias("yr"), F.struct(*_holed()).alias("o"))
    column_sketches(dated.select("o.*", "yr"), ["yr"]).write.parquet(path)
    merged = merged_sketches(spark.read.parquet(path))
    told = sketched_profile(merged, orders.schema)
    # One number per estimate; the rows are read once to judge all of them.
    leaves = [(i, col, field.dataType) for i, (_, field, col) in enumerate(schema_leaves(orders.schema))]
    numbers = [(i, F.when(~F.isnan(col.cast("double")), col.cast("double"))) for i, col, t in leaves if isinstance(t, T.NumericType)]
    middle = {i: told.where(F.col("pos") == i).select(F.col("quantiles")[0]).scalar() for i, _ in numbers}
    judged = orders.select(
        *[col.alias(f"v{i}") for i, col, t in leaves if not isinstance(t, T.StructType)],
        *[c.alias(f"n{i}") for i, c in numbers],
        *[middle[i].alias(f"m{i}") for i, _ in numbers],
    ).agg(
        *[F.countDistinct(f"v{i}").alias(f"d{i}") for i, _, t in leaves if not isinstance(t, T.StructType)],
        *[F.avg((F.col(f"n{i}") < F.col(f"m{i}")).cast("int")).alias(f"below{i}") for i, _ in numbers],
        *[F.avg((F.col(f"n{i}") <= F.col(f"m{i}")).cast("int")).alias(f"upto{i}") for i, _ in numbers],
    )
    exact = F.array(
        *[
            F.struct(
                F.lit(i).alias("of"),
                (F.col(f"d{i}") if not isinstance(t, T.StructType) else F.lit(None).cast("long")).alias("distinct"),
                ((F.col(f"below{i}") <= 0.5 + RANK_ERROR) & (F.col(f"upto{i}") >= 0.5 - RANK_ERROR)
                 if i in middle else F.lit(None).cast("boolean")).alias("close_median"),
            )
            for i, _, t in leaves
        ]
    )
    close = F.abs(F.col("distinct_count") - F.col("distinct")) <= DISTINCT_ERROR * F.col("distinct") + 1
    return told.join(judged.select(F.inline(exact)), F.col("pos") == F.col("of")).select(
        "path", "type", "value_count", "null_count", "nan_count", "lower", "upper",
        close.alias("close_distinct"), "close_median",
    )


PROFILE_MERGED = f"""
    SELECT path, type, value_count, null_count, nan_count, lower, upper,
           CASE WHEN path <> 'customer' THEN TRUE END AS close_distinct,
           CASE WHEN type IN ('bigint', 'double') THEN TRUE END AS close_median
    FROM ({PROFILE_ORDERS})
"""


def daily_log(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_log(table(spark, folder, "events"), "ts")


def snapshots_events(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots(daily_log(spark, folder)).select(
        F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("committed_at"),
        "snapshot_id",
        "parent_id",
        "operation",
        F.to_json("summary").alias("summary"),
    )


SNAPSHOTS = """
    WITH daily AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, max(ts) AS last FROM events GROUP BY 1)
    SELECT strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS committed_at, CAST(epoch(d) AS BIGINT) AS snapshot_id,
           lag(CAST(epoch(d) AS BIGINT)) OVER (ORDER BY d) AS parent_id, 'append' AS operation,
           '{"added-records":"' || n || '","total-records":"' || CAST(sum(n) OVER (ORDER BY d) AS BIGINT) || '"}'
               AS summary
    FROM daily ORDER BY d DESC LIMIT 250
"""


def yearly_orders(spark: SparkSession, folder: str) -> tuple[DataFrame, str]:
    """A copy of the orders partitioned by year, and where it lies."""
    path = scratch_path(spark, "orders-by-year")
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status"),
        F.when(F.col("o_orderkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("price"),
        F.year("o_orderdate").alias("yr"),
    )
    orders.hint("rebalance", "yr").write.partitionBy("yr").parquet(path)
    return spark.read.parquet(path), path


def yearly_files(spark: SparkSession, folder: str) -> DataFrame:
    """Its files from the listing and the footers; no rows are read."""
    copy, path = yearly_orders(spark, folder)
    return footer_inventory(copy, file_footers(spark, path), ["yr"])


def files_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The file list rolled up per partition, which must equal aggregates over the rows.

    Only ``price`` is read, for its NaNs; all else comes from listing, footers and paths.
    """
    copy, path = yearly_orders(spark, folder)
    listed = parquet_files(copy, list_files(spark, path), ["yr"], n=None, nan_counts=True)
    names = ("o_orderkey", "status", "price")

    def total(kind: str, name: str):
        return F.sum(F.coalesce(F.try_element_at(kind, F.lit(name)), F.lit(0)))

    return listed.groupBy(F.col("partition.yr").alias("yr")).agg(
        F.sum("record_count").alias("record_count"),
        *[total("null_value_counts", n).alias(f"{n}_nulls") for n in names],
        total("nan_value_counts", "price").alias("price_nans"),
        F.min(F.element_at("lower_bounds", "price").cast("double")).alias("price_low"),
        F.max(F.element_at("upper_bounds", "price").cast("double")).alias("price_high"),
        F.min(F.try_element_at("lower_bounds", F.lit("status"))).alias("status_low"),
        F.bool_and((F.col("file_size_mb") > 0) & (F.size("split_offsets") > 0)).alias("has_bytes"),
        F.bool_and(F.size("column_sizes") == 3).alias("has_columns"),
    )


FILES_ORDERS = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS record_count,
           CAST(0 AS BIGINT) AS o_orderkey_nulls, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_nulls,
           CAST(0 AS BIGINT) AS price_nulls, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS price_nans,
           min(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS price_low,
           max(o_totalprice) FILTER (WHERE o_orderkey % 7 <> 0) AS price_high,
           min(nullif(o_orderstatus, 'F')) AS status_low, TRUE AS has_bytes, TRUE AS has_columns
    FROM orders GROUP BY 1
"""


def footers_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and values per column from file footers alone."""
    foot = file_footers(spark, f"{folder}/lineitem.parquet")
    return foot.select(F.explode("value_counts").alias("column", "n"), "record_count").groupBy("column").agg(
        F.sum("n").alias("values"), F.sum("record_count").alias("rows")
    )


LINE_FIELDS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()
FOOTERS_LINEITEM = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS values, count(*) AS rows FROM lineitem" for c in LINE_FIELDS
)


def partitions_orders(spark: SparkSession, folder: str) -> DataFrame:
    found = partitions(yearly_files(spark, folder))
    return found.select(
        F.col("partition.yr").alias("yr"),
        "record_count",
        (F.col("file_count") > 0).alias("has_files"),
        (F.col("total_size_bytes") > 0).alias("has_bytes"),
        F.col("last_updated_at").isNotNull().alias("has_time"),
    )


PARTITIONS_ORDERS = """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, count(*) AS record_count, TRUE AS has_files,
           TRUE AS has_bytes, TRUE AS has_time
    FROM orders GROUP BY 1
"""


def partitions_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Partitions of orders by status and year; ``record_count`` clashes with a partition field."""
    parts = table(spark, folder, "orders").groupBy(
        "o_orderstatus", F.year("o_orderdate").alias("yr")
    ).agg(F.count(F.lit(1)).alias("record_count"))
    held = F.struct(F.col("yr").alias("record_count"), F.col("o_orderstatus").alias("status"))
    listed = parts.select(
        F.when(F.col("o_orderstatus") != "P", held).alias("partition"), "record_count", F.col("yr").alias("spec")
    )
    return flatten_partition(listed).select(F.col("record_count").cast("long"), "spec", "status")


PARTITIONS_FLAT = """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) ELSE count(*) END AS record_count,
           CAST(year(o_orderdate) AS INTEGER) AS spec, nullif(o_orderstatus, 'P') AS status
    FROM orders GROUP BY o_orderstatus, year(o_orderdate)
"""


def metrics_events(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot numbers from the events, partition columns from the copy of the orders."""
    inventory = yearly_files(spark, folder)
    metrics = table_metrics(daily_log(spark, folder), inventory, df=table(spark, folder, "events"))
    return metrics.withColumn("avg_file_size", F.col("avg_file_size").rlike(r"^\d+\.\d\d MB$"))


def metrics_files(spark: SparkSession, folder: str) -> DataFrame:
    """Without snapshots the rows of the files count, and times are not known."""
    copy, path = yearly_orders(spark, folder)
    inventory = footer_inventory(copy, file_footers(spark, path))
    metrics = table_metrics(file_rows=inventory, df=copy)
    return metrics.withColumn("avg_file_size", F.col("avg_file_size").rlike(r"^\d+\.\d\d MB$"))


METRICS_EVENTS = """
    SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_snapshot,
           strftime(min(last), '%Y-%m-%d %H:%M:%S.%f') AS earliest_snapshot,
           format('{:,}', CAST(sum(n) AS BIGINT)) AS row_count, '6' AS column_count, TRUE AS avg_file_size,
           'yr' AS partition_columns
    FROM (SELECT max(ts) AS ts, max(ts) AS last, count(*) AS n FROM events GROUP BY date_trunc('day', ts))
"""
METRICS_FILES = """
    SELECT 'N/A' AS last_snapshot, 'N/A' AS earliest_snapshot, format('{:,}', count(*)) AS row_count,
           '4' AS column_count, TRUE AS avg_file_size, 'N/A' AS partition_columns
    FROM orders
"""

def overview_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A table is loaded and looked at by its name."""
    namespace, name = fresh_table(spark, "orders").split(".")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("yr"))
    seed_table(spark, f"{namespace}.{name}", "o_orderkey BIGINT, o_totalprice DOUBLE, yr INT", orders, ["yr"])
    seen = table_overview(spark, "spark_catalog", namespace, name)
    return seen.metrics.select(
        "*",
        F.lit(len(seen.schema["fields"])).alias("fields"),
        F.lit("PARTITIONED BY (yr)" in seen.ddl).alias("partitioned"),
        F.lit(seen.snapshots is None).alias("no_snapshots"),
    ).withColumn("avg_file_size", F.col("avg_file_size").rlike(r"^\d+\.\d\d MB$"))


OVERVIEW_ORDERS = f"""
    SELECT * REPLACE ('3' AS column_count, 'yr' AS partition_columns),
           CAST(3 AS INTEGER) AS fields, TRUE AS partitioned, TRUE AS no_snapshots
    FROM ({METRICS_FILES})
"""

QUERIES = {
    "overview_orders": Query(overview_orders, OVERVIEW_ORDERS),
    "profile_orders": Query(profile_orders, PROFILE_ORDERS),
    "profile_merged": Query(profile_merged, PROFILE_MERGED),
    "snapshots_events": Query(snapshots_events, SNAPSHOTS),
    "files_orders": Query(files_orders, FILES_ORDERS),
    "footers_lineitem": Query(footers_lineitem, FOOTERS_LINEITEM),
    "partitions_orders": Query(partitions_orders, PARTITIONS_ORDERS),
    "partitions_flat": Query(partitions_flat, PARTITIONS_FLAT),
    "metrics_events": Query(metrics_events, METRICS_EVENTS),
    "metrics_files": Query(metrics_files, METRICS_FILES),
}
