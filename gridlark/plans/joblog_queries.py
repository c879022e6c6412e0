"""Job log queries. The log is derived from ``events``.

For job states a user is a job and each event is a state change; for lists an event is a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.joblog import (
    day_summary,
    fetchable,
    get_jobs,
    history_by_day,
    job_state,
    list_jobs,
    next_job,
    recent_queries,
    retention,
)
from gridlark.plans.load_queries import fresh_table
from gridlark.plans.query import Query
from gridlark.sources.scratch import scratch_namespace
from gridlark.sources.tables import attach, stream_table, table
from gridlark.streaming.jobstate import run_job_state

# The state that an event type stands for.
STATE_OF = {
    "view": "queued",
    "signup": "queued",
    "click": "running",
    "purchase": "succeeded",
    "error": "failed",
}
STATE_SQL = "CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'queued' END"
TODAY = "2024-01-30"


def state_of(event_type):
    pairs = [F.lit(x) for pair in STATE_OF.items() for x in pair]
    return F.create_map(*pairs)[event_type]


def as_events(events: DataFrame) -> DataFrame:
    """Every event as a state change of the job that its user stands for."""
    return events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        F.col("event_id").alias("seq"),
        state_of(F.col("event_type")).alias("status"),
        F.concat(F.lit("SELECT "), "props").alias("query_text"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )


def as_jobs(events: DataFrame) -> DataFrame:
    """Every event as a job of its own."""
    return events.select(
        F.col("event_id").alias("job_id"),
        state_of(F.col("event_type")).alias("status"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("SELECT "), "props").alias("query_text"),
    )


def micros(column: str):
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def shown_state(states: DataFrame) -> DataFrame:
    return states.select(
        "job_id", "query_text", "status", "error_message",
        micros("created_at"), micros("started_at"), micros("completed_at"),
    )


def q_job_state(spark: SparkSession, folder: str) -> DataFrame:
    return shown_state(job_state(as_events(table(spark, folder, "events"))))


def q_job_state_stream(spark: SparkSession, folder: str) -> DataFrame:
    return shown_state(run_job_state(spark, as_events(stream_table(spark, folder, "events"))))


JOB_STATE = f"""
    WITH log AS (
        SELECT user_id AS job_id, ts, event_id, {STATE_SQL} AS status, 'SELECT ' || props AS query_text,
               CASE WHEN event_type = 'error' THEN props END AS error_message,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last
        FROM events
    )
    SELECT job_id, max(query_text) FILTER (WHERE first = 1) AS query_text,
           max(status) FILTER (WHERE last = 1) AS status,
           max(error_message) FILTER (WHERE last = 1) AS error_message,
           strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
           strftime(max(ts) FILTER (WHERE status = 'running'), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           strftime(max(ts) FILTER (WHERE status IN ('succeeded', 'failed')), '%Y-%m-%d %H:%M:%S.%f')
               AS completed_at
    FROM log GROUP BY job_id
"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return as_jobs(table(spark, folder, "events"))


def shown_jobs(rows: DataFrame) -> DataFrame:
    return rows.select("job_id", "status", micros("created_at"))


JOBS = f"""
    SELECT event_id AS job_id, {STATE_SQL} AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at
    FROM events
"""


def q_next_job(spark, folder):
    return shown_jobs(next_job(jobs(spark, folder)))


def q_jobs_newest(spark, folder):
    return shown_jobs(list_jobs(jobs(spark, folder)))


def q_jobs_by_id(spark, folder):
    return shown_jobs(get_jobs(jobs(spark, folder), table(spark, folder, "labels").select("doc_id")))


def order_jobs(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("queued").alias("status"),
    )


def q_jobs_kept(spark, folder):
    return shown_jobs(retention(order_jobs(spark, folder))[0])


def q_jobs_evicted(spark, folder):
    return shown_jobs(retention(order_jobs(spark, folder))[1])


def q_jobs_evicted_closed(spark, folder):
    return shown_jobs(retention(order_jobs(spark, folder), protect_open=True)[1])


ORDER_JOBS = """
    SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' ELSE 'queued' END AS status,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS created_at
    FROM orders
"""
NEWEST_ORDERS = "(SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)"

DAY_LABEL = f"""
    CASE WHEN CAST(ts AS DATE) = DATE '{TODAY}' THEN 'Today'
         WHEN CAST(ts AS DATE) = DATE '{TODAY}' - INTERVAL 1 DAY THEN 'Yesterday'
         ELSE strftime(ts, '%b %-d, %Y') END
"""


def q_jobs_by_day(spark, folder):
    return history_by_day(jobs(spark, folder), TODAY).select("label", "job_id", "status", micros("created_at"))


def q_jobs_day_summary(spark, folder):
    return day_summary(jobs(spark, folder), TODAY).select("label", "jobs", micros("newest"))


def q_recent_queries(spark, folder):
    """Texts of conversations as submitted queries, with uneven white space around them."""
    padding = F.when(F.col("role") == "user", F.lit(" \n")).otherwise(F.lit("\t"))
    log = table(spark, folder, "conversations").select(
        F.concat(padding, "text", padding).alias("query_text"),
        F.col("conv_id").alias("ts"),
        F.col("turn").alias("seq"),
    )
    return recent_queries(log).select("query", "ts", "seq")


RECENT_QUERIES = """
    WITH log AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS query, conv_id, turn FROM conversations),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY conv_id DESC, turn DESC) AS r FROM log)
    SELECT query, conv_id AS ts, turn AS seq FROM ranked
    WHERE r = 1 AND query <> '' ORDER BY conv_id DESC, turn DESC LIMIT 50
"""


def q_jobs_fetchable(spark, folder):
    ids = table(spark, folder, "documents").select((F.col("doc_id") * 11).alias("job_id"))
    return fetchable(jobs(spark, folder), ids)


JOBS_FETCHABLE = f"""
    SELECT DISTINCT d.doc_id * 11 AS job_id,
           CASE WHEN j.job_id IS NULL THEN 'not found' WHEN j.status = 'succeeded' THEN 'found'
                ELSE 'not complete' END AS reason
    FROM documents d LEFT JOIN ({JOBS}) j ON j.job_id = d.doc_id * 11
"""

QUERIES = {
    "job_state": Query(q_job_state, JOB_STATE),
    "job_state_stream": Query(q_job_state_stream, JOB_STATE),
    "next_job": Query(
        q_next_job, f"SELECT * FROM ({JOBS}) WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1"
    ),
    "jobs_newest": Query(q_jobs_newest, JOBS),
    "jobs_by_id": Query(q_jobs_by_id, f"SELECT * FROM ({JOBS}) WHERE job_id IN (SELECT doc_id FROM labels)"),
    "jobs_kept": Query(q_jobs_kept, f"SELECT * FROM ({ORDER_JOBS}) WHERE job_id IN {NEWEST_ORDERS}"),
    "jobs_evicted": Query(q_jobs_evicted, f"SELECT * FROM ({ORDER_JOBS}) WHERE job_id NOT IN {NEWEST_ORDERS}"),
    "jobs_evicted_closed": Query(
        q_jobs_evicted_closed,
        f"SELECT * FROM ({ORDER_JOBS}) WHERE job_id NOT IN {NEWEST_ORDERS} AND status = 'succeeded'",
    ),
    "jobs_by_day": Query(
        q_jobs_by_day,
        f"SELECT {DAY_LABEL} AS label, event_id AS job_id, {STATE_SQL} AS status, "
        "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS created_at FROM events",
    ),
    "jobs_day_summary": Query(
        q_jobs_day_summary,
        f"SELECT {DAY_LABEL} AS label, count(*) AS jobs, "
        "strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS newest FROM events GROUP BY 1",
    ),
    "recent_queries": Query(q_recent_queries, RECENT_QUERIES),
    "jobs_fetchable": Query(q_jobs_fetchable, JOBS_FETCHABLE),
}
