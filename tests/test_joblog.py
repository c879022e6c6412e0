"""Job states, lists, retention, history; in batch and as a stream."""

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlark.operators import joblog
from gridlark.sources.scratch import scratch_namespace
from gridlark.sources.folder import Folder
from gridlark.streaming import jobstate
from gridlark.streaming.jobstate import keep_job_state, latest_job_state

EVENTS = "job_id STRING, ts TIMESTAMP, seq BIGINT, status STRING, query_text STRING, error_message STRING"
T0 = datetime(2024, 5, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


LOG = [
    ("a", at(0), 1, "queued", "SELECT 1", None),
    ("a", at(1), 2, "running", None, None),
    ("a", at(2), 3, "succeeded", None, None),
    ("b", at(0), 4, "queued", "SELECT x", None),
    ("b", at(3), 5, "running", None, None),
    ("b", at(4), 6, "failed", None, "no column x"),
    ("c", at(5), 7, "queued", "SELECT 2", None),
    ("d", at(6), 8, "queued", "SELECT 3", None),
    ("d", at(7), 9, "running", None, None),
    # An update after a failure, without a message, clears it.
    ("e", at(1), 10, "queued", "SELECT 4", None),
    ("e", at(2), 11, "failed", None, "lost"),
    ("e", at(2), 12, "running", None, None),
    ("f", at(9), 13, "nonsense", "SELECT 5", None),
]
STATES = {
    "a": ("SELECT 1", "succeeded", None, at(0), at(1), at(2)),
    "b": ("SELECT x", "failed", "no column x", at(0), at(3), at(4)),
    "c": ("SELECT 2", "queued", None, at(5), None, None),
    "d": ("SELECT 3", "running", None, at(6), at(7), None),
    "e": ("SELECT 4", "running", None, at(1), at(2), at(2)),
}


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(LOG, EVENTS)


@pytest.fixture(scope="module")
def jobs(events):
    return joblog.job_state(events)


def as_dict(df):
    return {r.job_id: tuple(r)[1:] for r in df.collect()}


def test_states(jobs):
    assert as_dict(jobs) == STATES


def test_states_are_added_up_before_the_shuffle(jobs):
    plan = jobs._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.index("partial_max") > plan.index("Exchange hashpartitioning(job_id")


def test_next_is_the_oldest_that_waits(spark, jobs):
    assert [r.job_id for r in joblog.next_job(jobs).collect()] == ["c"]
    assert joblog.next_job(jobs.where("status != 'queued'")).count() == 0


def test_newest_first(jobs):
    assert [r.job_id for r in joblog.list_jobs(jobs).collect()] == ["d", "c", "e", "b", "a"]


def test_by_id(spark, jobs):
    ids = spark.createDataFrame([("a",), ("a",), ("zz",)], "id STRING")
    assert [r.job_id for r in joblog.get_jobs(jobs, ids).collect()] == ["a"]


def test_fetchable(spark, jobs):
    ids = spark.createDataFrame([("a",), ("b",), ("zz",)], "id STRING")
    got = {r.job_id: r.reason for r in joblog.fetchable(jobs, ids).collect()}
    assert got == {"a": "found", "b": "not complete", "zz": "not found"}


def five(spark):
    rows = [(f"job{i}", at(i), "queued" if i == 0 else "succeeded") for i in range(5)]
    return spark.createDataFrame(rows, "job_id STRING, created_at TIMESTAMP, status STRING")


def test_retention(spark):
    kept, evicted = joblog.retention(five(spark), 3)
    assert {r.job_id for r in kept.collect()} == {"job4", "job3", "job2"}
    assert {r.job_id for r in evicted.collect()} == {"job0", "job1"}
    assert joblog.retention(five(spark), 50)[1].count() == 0


def test_retention_can_spare_open_jobs(spark):
    kept, evicted = joblog.retention(five(spark), 3, protect_open=True)
    assert {r.job_id for r in kept.collect()} == {"job4", "job3", "job2", "job0"}
    assert {r.job_id for r in evicted.collect()} == {"job1"}


def test_eviction_reads_each_job_where_it_lies(spark):
    plan = joblog.retention(five(spark), 3)[1]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan


def test_history(spark):
    rows = [
        ("n", datetime(2024, 3, 2, 8)), ("o", datetime(2024, 3, 2, 9)),
        ("y", datetime(2024, 3, 1, 23, 59)), ("l", datetime(2024, 2, 29, 1)), ("z", datetime(2023, 12, 31)),
    ]
    df = spark.createDataFrame(rows, "job_id STRING, created_at TIMESTAMP")
    got = [(r.label, r.job_id) for r in joblog.history_by_day(df, "2024-03-02").collect()]
    assert got == [("Today", "o"), ("Today", "n"), ("Yesterday", "y"), ("Feb 29, 2024", "l"), ("Dec 31, 2023", "z")]
    days = [(r.label, r.jobs) for r in joblog.day_summary(df, "2024-03-02").collect()]
    assert days == [("Today", 2), ("Yesterday", 1), ("Feb 29, 2024", 1), ("Dec 31, 2023", 1)]


def test_recent_queries(spark):
    rows = [("a", 1, 1), (" \n", 2, 2), ("b ", 3, 3), ("\ta", 4, 4), ("c", 4, 5), ("", 9, 9)]
    log = spark.createDataFrame(rows, "query_text STRING, ts INT, seq INT")
    got = [(r["query"], r.query_text, r.ts) for r in joblog.recent_queries(log).collect()]
    assert got == [("c", "c", 4), ("a", "\ta", 4), ("b", "b ", 3)]
    assert [r["query"] for r in joblog.recent_queries(log, 1).collect()] == ["c"]


@pytest.mark.parametrize("merge_every", [1000, 2, 1])
def test_stream_equals_batch_over_restarts(spark, tmp_path, events, merge_every):
    """Files arrive between runs, late events among them; each run goes on from its checkpoint."""
    source, changes, checkpoint = (str(tmp_path / p) for p in ("in", "out", "check"))
    ordered = sorted(LOG, key=lambda r: (r[2] % 3, r[2]))
    for i in range(0, len(ordered), 4):
        batch = spark.createDataFrame(ordered[i : i + 4], EVENTS).coalesce(1)
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        keep_job_state(stream, changes, checkpoint, merge_every, 3)
    assert as_dict(latest_job_state(spark, changes).select("job_id", "query_text", "status", "error_message",
                                                          "created_at", "started_at", "completed_at")) == STATES


def test_a_failing_stream_raises(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(LOG, EVENTS).write.parquet(source)
    stream = spark.readStream.schema(EVENTS).parquet(source).where(F.raise_error(F.lit("broken")).isNull())
    with pytest.raises(Exception, match="broken"):
        keep_job_state(stream, str(tmp_path / "out"), str(tmp_path / "check"))


STATE = "job_id STRING, query_text STRING, status STRING, error_message STRING"


def log_of(spark, path, batches):
    """A change log as the stream writes it."""
    for n, rows in batches.items():
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={n}")


def test_merged_states_are_one_row_per_job(spark, tmp_path):
    """After many batches reading costs one stored row per job, and untouched buckets stay."""
    path = str(tmp_path / "log")
    log_of(spark, path, {n: [(f"j{n % 5}", f"q{n}", "queued", None), ("hot", f"h{n}", "running", None)] for n in range(30)})
    before = {tuple(r) for r in latest_job_state(spark, path).collect()}
    assert jobstate.merge_changes(spark, path, 16) == 30 and jobstate.merge_changes(spark, path, 16) == 0
    after = latest_job_state(spark, path)
    assert {tuple(r) for r in after.collect()} == before and len(before) == 6
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan
    folder = Folder(spark, path)
    old = jobstate._version(folder)["buckets"]
    log_of(spark, path, {30: [("j1", "new", "failed", "x")]})
    jobstate.merge_changes(spark, path)
    new = jobstate._version(folder)["buckets"]
    assert sum(old[b] != new[b] for b in new) == 1 and len(new) == len(old)
    assert ("j1", "new", "failed", "x") in {tuple(r) for r in latest_job_state(spark, path).collect()}
    assert folder.named("batch_id=", "") == [] and len(folder.named("_version-", ".json")) == 1


def test_a_failed_merge_changes_nothing_and_a_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    log_of(spark, path, {0: [("a", "1", "queued", None)], 1: [("a", "1", "running", None), ("b", "2", "queued", None)]})
    state = lambda: sorted(tuple(r) for r in latest_job_state(spark, path).collect())
    before = state()
    with monkeypatch.context() as broken:
        broken.setattr(Folder, "write", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            jobstate.merge_changes(spark, path)
    assert state() == before
    jobstate.merge_changes(spark, path)
    assert state() == before
    # The stream repeats a batch that has been merged; what it holds is in the states already.
    log_of(spark, path, {0: [("a", "1", "queued", None)]})
    assert state() == before and jobstate.merge_changes(spark, path) == 0
