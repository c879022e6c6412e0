"""Questions over a log of submitted queries.

Events have the columns ``job_id, ts, seq, status, query_text, error_message``; ``(ts, seq)`` orders
the events of a job. Jobs are one row each: ``job_id, query_text, status, error_message, created_at,
started_at, completed_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.functions.text import stripped

# The states of a job, and how many jobs and query texts are kept.
QUEUED, RUNNING, SUCCEEDED, FAILED = "queued", "running", "succeeded", "failed"
STATES = (QUEUED, RUNNING, SUCCEEDED, FAILED)
ENDED = (SUCCEEDED, FAILED)
KEPT_JOBS = 50
KEPT_QUERIES = 50


def known_states(events: DataFrame) -> DataFrame:
    """Events whose status is one of the four states."""
    return events.where(F.col("status").isin(*STATES))


def state_columns() -> list[Column]:
    """Aggregates that fold the events of a job into its state.

    Each merges partial results in any order, so a job with very many events is reduced on the map
    side, and a stream can use the same columns. The newest event gives status and error message,
    a null message included.
    """
    newest = F.max(F.struct("ts", "seq", "status", "error_message"))
    at = lambda *states: F.max(F.when(F.col("status").isin(*states), F.col("ts")))
    return [
        F.min(F.struct("ts", "seq", "query_text")).getField("query_text").alias("query_text"),
        newest.getField("status").alias("status"),
        newest.getField("error_message").alias("error_message"),
        F.min("ts").alias("created_at"),
        at(RUNNING).alias("started_at"),
        at(*ENDED).alias("completed_at"),
    ]


def job_state(events: DataFrame) -> DataFrame:
    """Current state of every job."""
    return known_states(events).groupBy("job_id").agg(*state_columns())


def next_job(jobs: DataFrame) -> DataFrame:
    """The queued job that waits longest."""
    return jobs.where(F.col("status") == QUEUED).orderBy("created_at", "job_id").limit(1)


def list_jobs(jobs: DataFrame) -> DataFrame:
    """All jobs, newest first; equal times are ordered by id."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id"))


def get_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Jobs whose id is in the one-column ``ids``; an unknown id gives no row."""
    wanted = ids.select(F.col(ids.columns[0]).alias("job_id")).distinct()
    return jobs.join(wanted, "job_id", "left_semi")


def retention(
    jobs: DataFrame, n: int = KEPT_JOBS, protect_open: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` jobs, and all others, which are to be deleted.

    Only ``n`` ids are sent to the tasks, all other rows are filtered where they lie. With
    ``protect_open`` a queued or running job is kept besides.
    """
    newest = list_jobs(jobs).limit(n)
    ids = F.broadcast(newest.select("job_id"))
    kept, evicted = newest, jobs.join(ids, "job_id", "left_anti")
    if protect_open:
        still_open = ~F.col("status").isin(*ENDED)
        kept = kept.unionByName(evicted.where(still_open))
        evicted = evicted.where(~still_open)
    return kept, evicted


def day_label(at: Column, today: Column) -> Column:
    """``Today``, ``Yesterday``, else the date as ``Mon D, YYYY``."""
    day = F.to_date(at)
    return (
        F.when(day == today, "Today")
        .when(day == F.date_sub(today, 1), "Yesterday")
        .otherwise(F.date_format(at, "MMM d, yyyy"))
    )


def history_by_day(jobs: DataFrame, today: str) -> DataFrame:
    """Jobs newest first, each with the label of its day.

    Rows of a day follow each other, days are newest first. Groups stay rows: a day may hold most
    of the log, so nothing is collected per day.
    """
    label = day_label(F.col("created_at"), F.to_date(F.lit(today)))
    return list_jobs(jobs.withColumn("label", label))


def day_summary(jobs: DataFrame, today: str) -> DataFrame:
    """Each day label with its number of jobs and newest job time, newest day first."""
    return (
        jobs.groupBy(day_label(F.col("created_at"), F.to_date(F.lit(today))).alias("label"))
        .agg(F.count(F.lit(1)).alias("jobs"), F.max("created_at").alias("newest"))
        .orderBy(F.desc("newest"))
    )


def recent_queries(log: DataFrame, n: int = KEPT_QUERIES) -> DataFrame:
    """The newest ``n`` distinct query texts of ``(query_text, ts, seq)``.

    The text without outer white space is the key, its latest submission wins, blanks are dropped.
    A digest stands for the key, so that each text is sorted and sent once, not twice.
    """
    query = stripped(F.col("query_text"))
    return (
        log.where(query != "")
        .groupBy(F.sha2(query, 256).alias("digest"))
        .agg(F.max(F.struct("ts", "seq", "query_text")).alias("latest"))
        .select("latest.*")
        .orderBy(F.desc("ts"), F.desc("seq"))
        .limit(n)
        .select(query.alias("query"), "ts", "seq", "query_text")
    )


def fetchable(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id with ``found``, ``not found`` or ``not complete``."""
    asked = ids.select(F.col(ids.columns[0]).alias("job_id")).distinct()
    states = jobs.select("job_id", "status", F.lit(True).alias("_there"))
    reason = (
        F.when(F.col("_there").isNull(), "not found")
        .when(F.col("status") == SUCCEEDED, "found")
        .otherwise("not complete")
    )
    return asked.join(states, "job_id", "left").select("job_id", reason.alias("reason"))
