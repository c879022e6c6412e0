"""Profiles, snapshots, files, partitions, headline numbers, overview, inventory, seeding."""

import uuid
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridlark.operators import inspect, inventory, overview
from gridlark.plans import sqlset
from gridlark.plans.load_queries import LOG_DDL
from gridlark.sources import catalog, footers, scratch, seed


@pytest.fixture(scope="module")
def namespace(spark):
    return scratch.scratch_namespace(spark, f"gridlark_test_{uuid.uuid4().hex[:8]}")


def test_profile(spark):
    nan = float("nan")
    rows = [(1, nan, (5, None), [1], bytearray(b"a")), (2, 2.5, None, None, bytearray(b"\xff")), (None, None, (6, "x"), [], None)]
    df = spark.createDataFrame(rows, "i INT, d DOUBLE, s STRUCT<a: INT, b: STRING>, l ARRAY<INT>, bin BINARY")
    got = {r.path: tuple(r)[2:] for r in inspect.column_profile(df).collect()}
    assert got == {
        "i": ("int", True, 3, 1, None, "1", "2"),
        "d": ("double", True, 3, 1, 1, "2.5", "2.5"),
        "s": ("struct<a:int,b:string>", True, 3, 1, None, None, None),
        "s.a": ("int", True, 3, 1, None, "5", "6"),
        "s.b": ("string", True, 3, 2, None, "x", "x"),
        "l": ("array<int>", True, 3, 1, None, None, None),
        "bin": ("binary", True, 3, 1, None, "a", "/w=="),
    }


def test_profile_is_one_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id * 2 AS b", "id * 3 AS c").write.parquet(path)
    plan = inspect.column_profile(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_grid_columns(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, true AS c, CAST(NULL AS INT) AS d, array(1) AS e, 9007199254740993L AS f, 1.5 AS g")
    got = [(r.name, r.type) for r in inspect.grid_columns(df).orderBy("pos").collect()]
    assert got == [("a", "number"), ("b", "string"), ("c", "boolean"), ("d", "object"), ("e", "object"), ("f", "string"), ("g", "number")]
    assert inspect.grid_columns(df.limit(0)).count() == 0


LOG = "committed_at TIMESTAMP, snapshot_id BIGINT, summary MAP<STRING, STRING>"


def metrics(**sources):
    return inspect.table_metrics(**sources).first().asDict()


def test_metrics(spark):
    log = spark.createDataFrame(
        [(datetime(2023, 1, 1), 1, {"total-records": "60"}), (datetime(2023, 1, 2), 2, {"total-records": "100"})], LOG
    )
    files = spark.createDataFrame([(100, 1048576)], "record_count BIGINT, file_size_in_bytes BIGINT")
    parts = spark.createDataFrame([(("2023-01-01",),)], "partition STRUCT<day: STRING>")
    df = spark.sql("SELECT 1 AS a, 2 AS b, 3 AS c")
    assert metrics(snapshot_rows=log, file_rows=files, partition_rows=parts, df=df) == {
        "last_snapshot": "2023-01-02 00:00:00", "earliest_snapshot": "2023-01-01 00:00:00", "row_count": "100",
        "column_count": "3", "avg_file_size": "1.00 MB", "partition_columns": "day",
    }


def test_metrics_prefer_the_newest_snapshot(spark):
    files = spark.createDataFrame([(1234567, 1000), (1, 2097152)], "record_count BIGINT, file_size_in_bytes BIGINT")
    newest = [(datetime(2023, 1, 2, 3, 4, 5, 600), 2, {"total-records": "9876543"}), (datetime(2023, 1, 1), 1, {"total-records": "5"})]
    got = metrics(snapshot_rows=spark.createDataFrame(newest, LOG), file_rows=files)
    assert got["row_count"] == "9,876,543" and got["last_snapshot"] == "2023-01-02 03:04:05.000600"
    assert got["avg_file_size"] == "1.00 MB" and got["column_count"] == got["partition_columns"] == "N/A"
    silent = [(datetime(2023, 1, 2), 2, {"added-records": "1"}), (datetime(2023, 1, 1), 1, {"total-records": "5"})]
    assert metrics(snapshot_rows=spark.createDataFrame(silent, LOG), file_rows=files)["row_count"] == "1,234,568"
    odd = [(datetime(2023, 1, 2), 2, {"total-records": "many"})]
    assert metrics(snapshot_rows=spark.createDataFrame(odd, LOG), file_rows=files)["row_count"] == "1,234,568"


def test_metrics_of_nothing(spark):
    log, files = spark.createDataFrame([], LOG), spark.createDataFrame([], "record_count BIGINT, file_size_in_bytes BIGINT")
    parts = spark.createDataFrame([], "partition STRUCT<day: STRING>")
    assert set(metrics(snapshot_rows=log, file_rows=files, partition_rows=parts).values()) == {"N/A"}


def test_average_rounds_to_even(spark):
    files = spark.createDataFrame([(1, 131072)], "record_count BIGINT, file_size_in_bytes BIGINT")
    assert metrics(file_rows=files)["avg_file_size"] == "0.12 MB"
    large = spark.createDataFrame([(1, 5000 * 1048576)], "record_count BIGINT, file_size_in_bytes BIGINT")
    assert metrics(file_rows=large)["avg_file_size"] == "5000.00 MB"


def test_snapshots(spark):
    rows = [(datetime(2024, 1, 1, h),) for h in (1, 2)] + [(datetime(2024, 1, 3, 5),), (None,)]
    log = inspect.snapshot_log(spark.createDataFrame(rows, "ts TIMESTAMP"), "ts")
    got = [(r.committed_at, r.parent_id, r.summary) for r in inspect.snapshots(log).collect()]
    first = 1704067200
    assert got == [
        (datetime(2024, 1, 3, 5), first, {"added-records": "1", "total-records": "3"}),
        (datetime(2024, 1, 1, 2), None, {"added-records": "2", "total-records": "2"}),
    ]
    assert inspect.snapshots(log, 1).count() == 1


@pytest.fixture(scope="module")
def odd_table(spark, tmp_path_factory):
    """Partition values with a space, a plus and a percent sign, and one file without rows."""
    path = str(tmp_path_factory.mktemp("files") / "odd")
    rows = [(i, float(i), "c d" if i % 3 == 0 else "a+b%") for i in range(30)] + [(30, float("nan"), "c d"), (31, None, "c d")]
    spark.createDataFrame(rows, "id INT, v DOUBLE, p STRING").repartition(2, "id").write.partitionBy("p").parquet(path)
    spark.createDataFrame([], "id INT, v DOUBLE").coalesce(1).write.parquet(f"{path}/p=empty")
    return path


def test_files_keep_empty_files(spark, odd_table):
    df = spark.read.parquet(odd_table)
    listing = footers.list_files(spark, odd_table)
    found = inspect.file_inventory(df, ["p"], listing)
    assert found.count() == listing.count() == 5
    told = footers.file_footers(spark, odd_table).select("file_path", "column_sizes", "split_offsets")
    listed = inspect.files(found.join(told, "file_path"), n=None)
    assert set(inspect.FILE_COLUMNS) == set(listed.columns)
    rows = listed.collect()
    assert sorted(r.record_count for r in rows)[0] == 0 and sum(r.record_count for r in rows) == 32
    full = [r for r in rows if r.record_count]
    assert {r.partition.p for r in full} == {"c d", "a+b%"}
    assert sum(r.null_value_counts["v"] for r in full) == 1 and sum(r.nan_value_counts["v"] for r in full) == 1
    assert all(set(r.column_sizes) == {"id", "v"} and r.split_offsets for r in full)
    assert max(float(r.upper_bounds["v"]) for r in full) == 29.0
    exact = {r.file_path: r.record_count for r in footers.file_footers(spark, odd_table).collect()}
    assert exact == {r.file_path: r.record_count for r in rows}


def test_file_list_is_capped_and_without_partition(spark, odd_table):
    flat = spark.read.parquet(f"{odd_table}/p=c d")
    listed = inspect.files(inspect.file_inventory(flat), n=1)
    assert listed.count() == 1 and "partition" not in listed.columns


def test_partitions(spark, odd_table):
    df = spark.read.parquet(odd_table)
    got = {r.partition.p: (r.record_count, r.file_count) for r in inspect.partitions(inspect.file_inventory(df, ["p"])).collect()}
    assert got == {"c d": (12, 2), "a+b%": (20, 2)}


def test_flatten(spark):
    df = spark.createDataFrame(
        [(("d1", 7), 10, 1), (None, 20, 2)], "partition STRUCT<day: STRING, record_count: INT>, record_count INT, spec_id INT"
    )
    flat = inspect.flatten_partition(df)
    assert flat.columns == ["record_count", "spec_id", "day"]
    assert [tuple(r) for r in flat.orderBy("spec_id").collect()] == [(7, 1, "d1"), (20, 2, None)]
    assert inspect.flatten_partition(flat).columns == flat.columns


def test_seed_is_idempotent(spark, namespace):
    name, ddl = f"{namespace}.ipgeo", "id BIGINT, ip STRING, city STRING, country STRING"
    assert [seed.seed_table(spark, name, ddl, seed.ipgeo(spark)) for _ in range(2)] == [True, False]
    table = spark.table(name)
    assert table.count() == 1000
    assert tuple(table.where("id = 256").first()) == (256, "192.168.1.1", "City_256", "Country_6")


def test_nested_partitioned_rows(spark, namespace):
    ddl = LOG_DDL
    rows = [(1, ("login", ("192.168.1.1", "Chrome")), date(2023, 10, 1)), (2, ("logout", ("10.0.0.1", "Safari")), date(2023, 10, 2))]
    name = f"{namespace}.logs"
    assert seed.seed_table(spark, name, ddl, spark.createDataFrame(rows, ddl), ["log_date"])
    got = spark.sql(f"SELECT event.context.browser AS b FROM {name} WHERE log_date = DATE '2023-10-02'")
    assert [r.b for r in got.collect()] == ["Safari"]
    assert "PartitionFilters: [isnotnull(log_date" in got._jdf.queryExecution().executedPlan().toString()
    seen = overview.table_overview(spark, "spark_catalog", namespace, "logs")
    assert [f["name"] for f in seen.schema["fields"]] == ["log_id", "event", "log_date"]
    assert "PARTITIONED BY (log_date)" in seen.ddl and seen.properties is not None and seen.snapshots is None
    assert seen.metrics.first().asDict() | {"avg_file_size": ""} == {
        "last_snapshot": "N/A", "earliest_snapshot": "N/A", "row_count": "2", "column_count": "3",
        "avg_file_size": "", "partition_columns": "log_date",
    }
    assert seen.files.count() == 2 and seen.partitions.count() == 2
    assert {r.upper_bounds["event.context.ip"] for r in seen.files.collect()} == {"192.168.1.1", "10.0.0.1"}
    assert "event.context.ip" in {r.path for r in seen.profile.collect()}


def test_metadata_of_the_format_comes_first(spark, namespace, monkeypatch):
    """A table format that keeps commits, files and partitions itself is read, not recomputed."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.kept (x INT) USING parquet")
    frames = {
        "snapshots": spark.createDataFrame([(datetime(2024, 1, 1), 7, {"total-records": "1500"})], LOG),
        "files": spark.sql(
            "SELECT 1 AS content, 'f1' AS file_path, 'ORC' AS file_format, 3 AS spec_id, named_struct('day', 'd') AS "
            "partition, 10L AS record_count, 1572864L AS file_size_in_bytes, map(1, 5L) AS column_sizes, map(1, 10L) AS "
            "value_counts, map(1, 0L) AS null_value_counts, map(1, 0L) AS nan_value_counts, map(1, X'01') AS "
            "lower_bounds, map(1, X'02') AS upper_bounds, CAST(NULL AS BINARY) AS key_metadata, array(4L) AS "
            "split_offsets, CAST(NULL AS ARRAY<INT>) AS equality_ids, 9 AS sort_order_id"
        ),
        "partitions": spark.sql("SELECT named_struct('day', 'd') AS partition, 10L AS record_count FROM range(300)"),
    }
    monkeypatch.setattr(overview, "metadata_table", lambda spark, name, kind: frames[kind])
    seen = overview.table_overview(spark, "spark_catalog", namespace, "kept")
    row = seen.files.first()
    assert (row.content, row.file_format, row.spec_id, row.file_size_mb, row.sort_order_id) == (1, "ORC", 3, 1.5, 9)
    assert seen.files.columns == inspect.FILE_COLUMNS
    assert seen.partitions.count() == 250 and seen.snapshots.first().snapshot_id == 7
    assert seen.metrics.first().asDict() == {
        "last_snapshot": "2024-01-01 00:00:00", "earliest_snapshot": "2024-01-01 00:00:00", "row_count": "1,500",
        "column_count": "1", "avg_file_size": "1.50 MB", "partition_columns": "day",
    }


def test_overview_of_a_view_and_of_nothing(spark, namespace):
    spark.sql(f"CREATE VIEW {namespace}.v AS SELECT 1 AS x")
    seen = overview.table_overview(spark, "spark_catalog", namespace, "v")
    assert seen.files is None and seen.partitions is None
    assert seen.metrics.first().row_count == "N/A" and seen.metrics.first().column_count == "1"
    with pytest.raises(AnalysisException):
        overview.table_overview(spark, "spark_catalog", namespace, "missing")
    with pytest.raises(ValueError):
        overview.table_overview(spark, "spark_catalog", namespace, "x; DROP TABLE y")


def test_loaded_inventory(spark, namespace):
    spark.range(3).createOrReplaceTempView("gridlark_temp_view")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.t1 (x INT) USING parquet")
    spark.sql(f"CREATE VIEW IF NOT EXISTS {namespace}.v1 AS SELECT 1 AS x")
    inv = catalog.load_inventory(spark)
    items = {r.name: r.type for r in inventory.list_items(inv, "spark_catalog", namespace).collect()}
    assert items["t1"] == "table" and items["v1"] == "view" and "gridlark_temp_view" not in items
    assert "spark_catalog" in {r.catalog for r in inventory.list_catalogs(inv).collect()}
    assert namespace in {r.namespace for r in inventory.list_namespaces(inv, "spark_catalog").collect()}
    hits = {(r.type, r.name) for r in inventory.search(inv, namespace.upper()).collect()}
    assert hits == {("namespace", namespace)}


def test_search_levels(spark):
    rows = [("Sales", "east", "t_100%", "table", False), ("Sales", "east", "t_100%", "view", False),
            ("Sales", "west", "plain", "table", False), ("bare", None, None, None, False),
            ("Sales", "", "tmp_sales", "view", True)]
    inv = spark.createDataFrame(rows, catalog.INVENTORY)
    hits = lambda text: sorted((r.type, r.name) for r in inventory.search(inv, text).collect())
    assert hits("SAL") == [("catalog", "Sales")]
    assert hits("%") == [("view", "t_100%")]
    assert hits("_") == [("view", "t_100%")]
    assert hits("st") == [("namespace", "east"), ("namespace", "west")]
    assert hits("bare") == [("catalog", "bare")]
    assert len(hits("")) == 6


def test_views_are_listed_without_tables(spark, monkeypatch):
    """Some catalogs leave views out of SHOW TABLES."""
    replies = {
        "SHOW TABLES IN `c`.only_views": [],
        "SHOW VIEWS IN `c`.only_views": [Row(viewName="v", isTemporary=False)],
        "SHOW TABLES IN `c`.bare": [],
        "SHOW VIEWS IN `c`.bare": None,
    }
    monkeypatch.setattr(catalog, "_shown", lambda _, statement: replies[statement])
    assert catalog._items(spark, "c", "only_views") == [("c", "only_views", "v", "view", False)]
    assert catalog._items(spark, "c", "bare") == [("c", "bare", None, None, False)]


def test_not_in_with_nulls(spark):
    """The registered rewrite of NOT IN against NOT IN itself, with nulls on either side."""
    text = sqlset.QUERIES["sub_notin"]
    parts = [(1, "a"), (2, "b"), (None, "c")]
    for lines in ([(1, 50.0)], [(1, 50.0), (None, 50.0)], [(1, 1.0)], []):
        spark.createDataFrame(parts, "p_partkey BIGINT, p_name STRING").createOrReplaceTempView("part")
        spark.createDataFrame(lines, "l_partkey BIGINT, l_quantity DOUBLE").createOrReplaceTempView("lineitem")
        rewritten, plain = (sorted(map(str, spark.sql(sql).collect())) for sql in (text.text, text.oracle))
        assert rewritten == plain


def test_partitions_and_numbers_read_no_rows(spark, namespace):
    """Listing, footers and paths are enough; odd partition values come back as they were."""
    rows = [(1, "a b"), (2, "x=y/z+é"), (3, None), (4, "a b")]
    spark.createDataFrame(rows, "id INT, p STRING").write.partitionBy("p").saveAsTable(f"{namespace}.odd_parts")
    seen = overview.table_overview(spark, "spark_catalog", namespace, "odd_parts")
    got = {r.partition.p: (r.record_count, r.file_count > 0) for r in seen.partitions.collect()}
    assert got == {"a b": (2, True), "x=y/z+é": (1, True), None: (1, True)}
    for frame in (seen.partitions, seen.metrics, seen.files):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" not in plan
    assert all(r.column_sizes and r.split_offsets for r in seen.files.collect())


def test_footers_agree_with_rows(spark, tmp_path):
    """Counts and bounds of every type from the footers are those of the rows; NaN only on request."""
    path = str(tmp_path / "typed")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        spark.range(400).selectExpr(
            "id", "CAST(id AS INT) - 200 AS i", "id % 2 = 0 AS b", "nullif(concat('é', id), 'é7') AS s",
            "CAST(id * 1.25 AS DECIMAL(12,3)) AS d", "CAST(id AS DECIMAL(30,2)) AS wide", "DATE'1960-01-01' + CAST(id AS INT) AS day",
            "timestamp_micros(id * 1000001 - 7) AS at", "CAST(timestamp_micros(id * 7) AS TIMESTAMP_NTZ) AS wall",
            "CAST(id AS FLOAT) / 3 AS f", "if(id % 9 = 0, double('NaN'), id / 7) AS x", "CAST(NULL AS INT) AS nothing",
            "CAST(concat('k', id) AS BINARY) AS raw", "named_struct('u', id, 'v', nullif(id, 5)) AS st", "array(id, id + 1) AS l",
        ).repartition(3, "id").write.option("parquet.block.size", 1024).parquet(path)
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    df = spark.read.parquet(path)
    listing = footers.list_files(spark, path)
    rows = {r.file_path: r for r in inspect.file_inventory(df, (), listing).collect()}
    told = {r.file_path: r for r in inspect.parquet_files(df, listing).collect()}
    exact = {r.file_path: r for r in inspect.parquet_files(df, listing, nan_counts=True).collect()}
    flat = "id i b s d wide day at wall f raw".split()
    for file, r in rows.items():
        t, e = told[file], exact[file]
        assert t.record_count == r.record_count and t.nan_value_counts is None
        for c in flat:
            assert (t.lower_bounds[c], t.upper_bounds[c]) == (r.lower_bounds[c], r.upper_bounds[c]), c
            assert (t.null_value_counts[c], t.value_counts[c]) == (r.null_value_counts[c], r.value_counts[c])
        assert t.null_value_counts["nothing"] == t.record_count and "nothing" not in t.lower_bounds
        assert t.lower_bounds["st.u"] == t.lower_bounds["id"] == t.lower_bounds["l.list.element"]
        for c in "xf":
            assert (e.lower_bounds[c], e.upper_bounds[c]) == (r.lower_bounds[c], r.upper_bounds[c])
            assert e.nan_value_counts[c] == r.nan_value_counts[c]
        assert e.lower_bounds["s"] == r.lower_bounds["s"]


def test_the_list_is_cut_before_footers_are_read(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(40).repartition(8).write.parquet(path)
    names = sorted(r.file_path for r in footers.list_files(spark, path).collect())
    with open(names[-1].removeprefix("file:"), "wb") as broken:
        broken.write(b"no parquet")
    df, listing = spark.read.schema("id LONG").parquet(path), footers.list_files(spark, path)
    assert [r.file_path for r in inspect.parquet_files(df, listing, n=7).select("file_path").collect()] == names[:7]
    scanned = inspect.parquet_files(df, listing, n=7)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in scanned


def test_a_broken_footer_fails_alone(spark, namespace):
    """Two numbers need the footers; the other four stay."""
    name = f"{namespace}.broken"
    spark.range(4).selectExpr("id", "id % 2 AS p").write.partitionBy("p").saveAsTable(name)
    seen = overview.table_overview(spark, "spark_catalog", namespace, "broken")
    listed = footers.list_files(spark, overview._storage(spark, name)[0]).first().file_path
    with open(listed.removeprefix("file:"), "wb") as broken:
        broken.write(b"no parquet")
    log = spark.createDataFrame([(datetime(2024, 1, 1), 7, {"added-records": "4"})], LOG)
    seen.measured["snapshot_rows"] = log
    assert seen.metrics.first().asDict() == {
        "last_snapshot": "2024-01-01 00:00:00", "earliest_snapshot": "2024-01-01 00:00:00", "row_count": "N/A",
        "column_count": "2", "avg_file_size": "N/A", "partition_columns": "p",
    }
