"""Creating tables and filling them once."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.text import checked_name

log = logging.getLogger(__name__)


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> bool:
    """Make a namespace if it is absent. A failure is logged, not raised."""
    place = f" LOCATION '{location}'" if location else ""
    namespace = checked_name(namespace)
    try:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}{place}")
        return True
    except Exception as e:
        log.warning("could not create namespace %s: %s", namespace, str(e).splitlines()[0])
        return False


def seed_table(
    spark: SparkSession, name: str, ddl: str, df: DataFrame, partition_by: list[str] | None = None
) -> bool:
    """Create the table if absent and append the rows only if it is empty.

    Running it again changes nothing. Returns whether rows were written.
    """
    name = checked_name(name)
    parts = f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet{parts}")
    if not spark.table(name).isEmpty():
        return False
    if partition_by:
        # Rows of a partition value meet in few files; adaptive execution splits a hot value into
        # tasks of the advisory size and joins small ones.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("append").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return True


# Fixed values of the generated address table.
ADDRESS_PREFIX = "192.168.1."
ADDRESSES = 255
COUNTRIES = 10
ADDRESS_ROWS = 1000


def ip_rows(ids: DataFrame, column: str = "id") -> DataFrame:
    """Address rows for a column of ids: address, city and country follow from the id."""
    i = F.col(column).cast("long")
    return ids.select(
        i.alias("id"),
        F.concat(F.lit(ADDRESS_PREFIX), (i % ADDRESSES).cast("string")).alias("ip"),
        F.concat(F.lit("City_"), i.cast("string")).alias("city"),
        F.concat(F.lit("Country_"), (i % COUNTRIES).cast("string")).alias("country"),
    )


def ipgeo(spark: SparkSession, n: int = ADDRESS_ROWS) -> DataFrame:
    """``n`` address rows, generated by the executors."""
    return ip_rows(spark.range(n))
