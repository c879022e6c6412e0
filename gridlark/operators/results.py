"""Query results: run, cap, save, load, drop, describe."""

from __future__ import annotations

import logging
import re
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.functions.text import checked_name, has_text
from gridlark.sources.seed import ensure_namespace

log = logging.getLogger(__name__)

# Rows kept per result, prefix of a saved result, characters kept of a job id.
RESULT_ROWS = 1000
RESULT_PREFIX = "job_"
NOT_IN_TABLE_NAME = r"[^a-zA-Z0-9_]"
# Stands between a result's name and the number of a stored version.
VERSION = "__version_"


def run_query(spark: SparkSession, sql: str, isolated: bool = False) -> DataFrame:
    """Run any SQL text.

    Unknown names and syntax errors raise here; run-time errors raise when the rows are used.
    ``isolated`` runs in a session of its own, so SET, USE and temporary views do not leak.
    """
    if not sql.strip():
        raise ValueError("query text is blank")
    return (spark.newSession() if isolated else spark).sql(sql)


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not all white space."""
    return df.where(has_text(F.col(column)))


def cap_rows(
    df: DataFrame,
    n: int = RESULT_ROWS,
    order_by: Sequence[str | Column] | None = None,
    merge_tasks: int | None = None,
) -> DataFrame:
    """At most ``n`` rows.

    With an order each task keeps its own first ``n`` rows and only those meet; without one it is
    open which rows stay. They meet in one task, which has ``n`` rows from every partition to merge:
    for a table of very many partitions give ``merge_tasks``, so that many tasks merge first.
    """
    if not order_by:
        return df.limit(n)
    if merge_tasks:
        group = Window.partitionBy("_group").orderBy(*order_by)
        df = (
            df.withColumn("_group", F.spark_partition_id() % merge_tasks)
            .withColumn("_place", F.row_number().over(group))
            .where(F.col("_place") <= n)
            .drop("_group", "_place")
        )
    return df.orderBy(*order_by).limit(n)


def row_count(df: DataFrame) -> int:
    """Rows of a result as retrieved, that is after the cap."""
    return df.count()


def result_name(job_id: str, namespace: str) -> str:
    return checked_name(namespace, RESULT_PREFIX + re.sub(NOT_IN_TABLE_NAME, "_", job_id))


def _versions(spark: SparkSession, name: str) -> list[str]:
    """Stored versions of a result, oldest first."""
    namespace, _, short = name.rpartition(".")
    listed = spark.sql(f"SHOW TABLES IN {namespace} LIKE '{short}{VERSION}*'").collect()
    return sorted(f"{namespace}.{r.tableName}" for r in listed if r.tableName.startswith(short.lower() + VERSION))


def save_result(
    df: DataFrame,
    job_id: str,
    namespace: str,
    n: int = RESULT_ROWS,
    order_by: Sequence[str | Column] | None = None,
) -> str | None:
    """Save the capped result under ``job_<id>``, replacing an earlier one.

    Rows are written to a table of their own first; ``job_<id>`` is a view that is pointed at it in one
    step once it is whole. So readers see the earlier result or the new one, a save that fails leaves the
    earlier one, and a query may read the result that it replaces. The version before stays stored until
    the next save, for readers that have begun with it. A command has no columns and leaves nothing to
    save: the name is ``None`` then.
    """
    if not df.columns:
        return None
    spark = df.sparkSession
    ensure_namespace(spark, namespace)
    name = result_name(job_id, namespace)
    earlier = _versions(spark, name)
    # Times first, so that names are in the order of saving.
    version = f"{name}{VERSION}{time.time_ns():016x}{uuid.uuid4().hex[:8]}"
    try:
        cap_rows(df, n, order_by).write.saveAsTable(version)
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {version} PURGE")
        raise
    for old in earlier[:-1]:
        spark.sql(f"DROP TABLE IF EXISTS {old} PURGE")
    return name


def load_result(
    spark: SparkSession, job_id: str, namespace: str, order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """Read a saved result back; a table keeps no order, so pass one to have it again."""
    df = spark.table(result_name(job_id, namespace))
    return df.orderBy(*order_by) if order_by else df


def drop_results(spark: SparkSession, job_ids: DataFrame | Iterable[str], namespace: str) -> int:
    """Drop the saved results of the given jobs; returns how many drops failed.

    The namespace's results are listed once and matched with the ids, so ids without a result cost
    nothing: statements are run for saved results alone, and one that fails stops no other.
    """
    if isinstance(job_ids, DataFrame):
        ids = job_ids.select(F.col(job_ids.columns[0]).cast("string").alias("job_id"))
    else:
        ids = spark.createDataFrame([(str(i),) for i in job_ids], "job_id string")
    namespace = checked_name(namespace)
    try:
        listed = spark.sql(f"SHOW TABLES IN {namespace} LIKE '{RESULT_PREFIX}*'")
    except Exception:
        log.warning("could not list the results in %s", namespace, exc_info=True)
        return ids.distinct().count()
    listed = listed.where(~F.col("isTemporary")).select(F.col("tableName").alias("name"))
    wanted = ids.select(F.lower(F.concat(F.lit(RESULT_PREFIX), F.regexp_replace("job_id", NOT_IN_TABLE_NAME, "_"))).alias("of"))
    result = F.regexp_replace(F.lower("name"), VERSION + r"[0-9a-f]{24}\z", "")
    found = listed.join(wanted.distinct(), result == F.col("of"), "left_semi").select("name")
    failed = set()
    # Views first: nobody finds a version that is about to go.
    for row in found.orderBy(F.col("name").contains(VERSION), "name").toLocalIterator():
        name = f"{namespace}.{row.name}"
        kind, purge = ("TABLE", " PURGE") if VERSION in row.name else ("VIEW", "")
        try:
            spark.sql(f"DROP {kind} IF EXISTS {name}{purge}")
        except Exception:
            failed.add(row.name.split(VERSION)[0])
            log.warning("could not drop %s", name, exc_info=True)
    return len(failed)


def result_schema(df: DataFrame) -> DataFrame:
    """Columns of a result in order: position, name, type text."""
    lines = [
        F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("name"), F.lit(str(f.dataType)).alias("type"))
        for i, f in enumerate(df.schema.fields)
    ]
    one = df.sparkSession.range(1)
    if not lines:
        return one.limit(0).select(F.lit(0).alias("pos"), F.lit("").alias("name"), F.lit("").alias("type"))
    return one.select(F.inline(F.array(*lines)))
