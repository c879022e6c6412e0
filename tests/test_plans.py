"""Plans of the registered queries, with automatic broadcasts off as if every table were large."""

import pytest

from __spark_entry__ import queries
from compare import DATA
from gridlark.plans import joblog_queries, ordered_queries, sqlset

FOLDER = str(DATA / "sf0.001")
# The evicted side of a retention broadcasts fifty ids; ordered queries broadcast their hot keys, one for
# each GROUP_ROWS rows at most, and splitters, four for each.
BOUNDED = {"jobs_evicted", "jobs_evicted_closed", *ordered_queries.QUERIES}
KEYS = [k for m in (sqlset, ordered_queries, joblog_queries) for k in m.QUERIES if "stream" not in k]


@pytest.fixture(scope="module")
def large(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield spark
    for n, value in zip(names, before):
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def plan(spark, key):
    return queries()[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", KEYS)
def test_joins_hold_at_any_size(large, key):
    text = plan(large, key)
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "EvalPython", "MapInPandas"):
        assert word not in text
    assert ("BroadcastHashJoin" in text) == (key in BOUNDED)


def test_filters_and_columns_reach_the_scan(spark, capsys):
    queries()["scan_filter_project"](spark, FOLDER).explain("formatted")
    lines = capsys.readouterr().out.splitlines()
    (pushed,) = [line for line in lines if line.startswith("PushedFilters")]
    (read,) = [line for line in lines if line.startswith("ReadSchema")]
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "In(l_returnflag" in pushed
    assert "l_partkey" not in read and "l_tax" not in read and "l_shipdate" in read


def test_groups_are_cut_before_the_shuffle(spark):
    text = plan(spark, "win_topn")
    assert "Partial" in text and text.count("WindowGroupLimit") == 2


def test_sorted_limits_keep_few_rows(spark):
    for key in ("topk", "limit_offset", "next_job", "recent_queries"):
        assert "TakeOrderedAndProject" in plan(spark, key)


@pytest.mark.parametrize("key", list(ordered_queries.QUERIES))
def test_ordered_queries_need_no_single_task(large, key):
    assert "SinglePartition" not in plan(large, key)


@pytest.mark.parametrize("key", list(ordered_queries.QUERIES))
def test_building_an_ordered_query_runs_no_job(spark, key):
    """Reading the schemas of the given files is the only job there is."""
    spark.sparkContext.setJobGroup(f"explain-{key}", "plans are built without jobs")
    try:
        frame = queries()[key](spark, FOLDER)
        frame._jdf.queryExecution().executedPlan()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"explain-{key}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    scanned = len({line for line in frame.inputFiles()})
    assert len(jobs) <= 2 and scanned
