"""Running, capping, saving and dropping."""

import time
import uuid

import pytest
from pyspark.errors import AnalysisException

from gridlark.operators import results
from gridlark.sources.scratch import scratch_namespace


@pytest.fixture(scope="module")
def namespace(spark):
    return scratch_namespace(spark, f"gridlark_test_{uuid.uuid4().hex[:8]}")


def test_errors_surface(spark):
    with pytest.raises(AnalysisException):
        results.run_query(spark, "SELECT nope FROM range(3)")
    with pytest.raises(ValueError):
        results.run_query(spark, " \n")
    failing = results.run_query(spark, "SELECT 1 / (id - id) AS x FROM range(3)")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        failing.collect()


def test_isolated_queries_do_not_leak(spark):
    results.run_query(spark, "CREATE TEMPORARY VIEW leak_check AS SELECT 1 AS x", isolated=True)
    assert not spark.catalog.tableExists("leak_check")


def test_cap(spark):
    df = spark.range(5000).repartition(7)
    assert results.row_count(results.cap_rows(df)) == 1000
    assert [r.id for r in results.cap_rows(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert results.row_count(results.cap_rows(spark.range(5))) == 5


def test_ordered_cap_does_not_sort_everything(spark):
    df = results.cap_rows(spark.range(5000).repartition(7), 10, ["id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_cap_can_merge_in_many_tasks(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS x").repartition(12)
    order = ["x", "id"]
    wide = results.cap_rows(df, 100, order, merge_tasks=3)
    assert wide.collect() == results.cap_rows(df, 100, order).collect()
    assert "WindowGroupLimit" in wide._jdf.queryExecution().executedPlan().toString()


def test_names():
    assert results.result_name("a-b.c;d", "ns") == "ns.job_a_b_c_d"
    with pytest.raises(ValueError):
        results.result_name("a", "ns; DROP TABLE x")


def test_save_load_replace_drop(spark, namespace):
    assert results.save_result(spark.range(1500), "x-1", namespace) == f"{namespace}.job_x_1"
    assert results.load_result(spark, "x-1", namespace).count() == 1000
    results.save_result(spark.range(3), "x-1", namespace)
    assert [r.id for r in results.load_result(spark, "x-1", namespace, ["id"]).collect()] == [0, 1, 2]
    assert results.drop_results(spark, ["x-1", "x-1", "unknown"], namespace) == 0
    assert not spark.catalog.tableExists(f"{namespace}.job_x_1")


def test_a_failed_save_leaves_the_earlier_result(spark, namespace):
    results.save_result(spark.range(3), "again", namespace)
    broken = spark.range(5).selectExpr("IF(id = 4, raise_error('lost'), 'x') AS word")
    with pytest.raises(Exception, match="lost"):
        results.save_result(broken, "again", namespace)
    name = results.result_name("again", namespace)
    assert results.load_result(spark, "again", namespace).count() == 3 and len(results._versions(spark, name)) == 1
    # A reader that began with the earlier version ends with it; a query may read what it replaces.
    reader = results.load_result(spark, "again", namespace)
    results.save_result(results.load_result(spark, "again", namespace).selectExpr("id + 10 AS bigger"), "again", namespace)
    assert reader.count() == 3
    assert [r.bigger for r in results.load_result(spark, "again", namespace, ["bigger"]).collect()] == [10, 11, 12]
    for i in range(3):
        results.save_result(spark.range(i), "again", namespace)
    assert len(results._versions(spark, name)) == 2
    results.save_result(spark.range(1), "again_2", namespace)
    assert results.drop_results(spark, ["again"], namespace) == 0
    assert results._versions(spark, name) == [] and results.load_result(spark, "again_2", namespace).count() == 1


def test_saved_types(spark, namespace):
    df = spark.sql(
        "SELECT 1.25D AS d, CAST(1.5 AS DECIMAL(20,3)) AS c, X'FF' AS b, DATE '2024-01-02' AS t, "
        "TIMESTAMP '2024-01-02 03:04:05.000006' AS ts, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS n, "
        "named_struct('x', array(1, NULL)) AS s, map('k', named_struct('y', CAST(NULL AS INT))) AS m"
    )
    results.save_result(df, "types", namespace)
    back = results.load_result(spark, "types", namespace)
    assert back.collect() == df.collect()
    assert [f.dataType.simpleString() for f in back.schema] == [f.dataType.simpleString() for f in df.schema]
    results.save_result(spark.sql("SELECT INTERVAL '2' DAY AS i, INTERVAL '3' MONTH AS y"), "odd", namespace)
    assert results.load_result(spark, "odd", namespace).count() == 1


def test_saved_times_are_unchanged(spark, namespace, monkeypatch):
    """Rows do not pass through the driver, whose own zone would move them."""
    monkeypatch.setenv("TZ", "Europe/Berlin")
    time.tzset()
    try:
        df = spark.sql(
            "SELECT explode(sequence(TIMESTAMP '2023-10-28 23:59:59.000007', TIMESTAMP '2023-10-29 03:00:00', "
            "INTERVAL 30 MINUTES)) AS ts UNION ALL SELECT make_timestamp(12000, 1, 1, 0, 0, 0)"
        )
        results.save_result(df, "times", namespace)
        back = results.load_result(spark, "times", namespace)
        micros = lambda d: sorted(r[0] for r in d.selectExpr("unix_micros(ts)").collect())
        assert micros(back) == micros(df)
    finally:
        monkeypatch.undo()
        time.tzset()


def test_drop_takes_a_frame_and_goes_on_after_a_failure(spark, namespace):
    results.save_result(spark.range(3), "x-2", namespace)
    ids = spark.createDataFrame([("x-2",), ("x-3",)], "job_id STRING")
    assert results.drop_results(spark, ids, namespace) == 0
    assert results.drop_results(spark, ["a", "b"], "no.such.place.at.all") == 2


def test_command_leaves_nothing_to_save(spark, namespace):
    done = results.run_query(spark, f"CREATE TABLE IF NOT EXISTS {namespace}.made (x INT) USING parquet")
    assert results.save_result(done, "cmd", namespace) is None
    assert spark.catalog.tableExists(f"{namespace}.made")


def test_schema(spark):
    df = spark.sql("SELECT 1L AS a, array(1) AS b, 'x' AS c")
    got = [tuple(r) for r in results.result_schema(df).orderBy("pos").collect()]
    assert got == [(0, "a", "LongType()"), (1, "b", "ArrayType(IntegerType(), False)"), (2, "c", "StringType()")]
