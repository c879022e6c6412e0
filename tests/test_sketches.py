"""Sketches of parts against the profile of their union."""

import pytest
from pyspark.sql import functions as F

from gridlark.operators import sketches
from gridlark.operators.inspect import column_profile


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(20_000).selectExpr(
        "id", "CAST(id % 7 AS TINYINT) AS tiny", "if(id % 9 = 0, double('NaN'), id / 3) AS x", "nullif(concat('é', id % 900), 'é3') AS s",
        "CAST(id AS DECIMAL(12,2)) / 4 AS d", "DATE'2020-01-01' + CAST(id % 400 AS INT) AS day", "CAST(NULL AS INT) AS nothing",
        "CAST(concat('k', id % 50) AS BINARY) AS raw", "named_struct('u', id % 11, 'l', array(id)) AS st", "id % 5 = 0 AS flag",
    )


EXACT = ["pos", "path", "type", "value_count", "null_count", "nan_count", "lower", "upper"]


def test_merged_profiles_are_the_profile_of_the_union(spark, rows, tmp_path):
    path = str(tmp_path / "sketches")
    sketches.column_sketches(rows, [(F.col("id") % 13).alias("part")]).write.parquet(path)
    stored = spark.read.parquet(path)
    assert stored.count() == 13
    told = sketches.sketched_profile(sketches.merged_sketches(stored), rows.schema, (0.1, 0.5, 1.0))
    exact = column_profile(rows)
    assert sorted(map(tuple, told.select(*EXACT).collect())) == sorted(map(tuple, exact.select(*EXACT).collect()))
    found = {r.path: r for r in told.collect()}
    for path, column in {"id": "id", "s": "s", "d": "d", "day": "day", "raw": "raw", "st.u": "st.u", "tiny": "tiny"}.items():
        n = rows.agg(F.countDistinct(column)).first()[0]
        assert abs(found[path].distinct_count - n) <= sketches.DISTINCT_ERROR * n + 1
    assert found["nothing"].distinct_count == 0 and found["nothing"].quantiles is None
    assert found["st"].distinct_count is None and found["s"].quantiles is None
    for path, most in (("id", 20_000), ("d", 5_000), ("x", 20_000 / 3)):
        low, middle, high = (q / most for q in found[path].quantiles)
        assert abs(low - 0.1) < sketches.RANK_ERROR and abs(middle - 0.5) < sketches.RANK_ERROR and high > 0.99


def test_merging_needs_no_rows_and_keeps_groups(spark, rows, tmp_path):
    path, data = str(tmp_path / "sketches"), str(tmp_path / "data")
    rows.repartition(4).write.parquet(data)
    stored = spark.read.parquet(data)
    file = F.col("_metadata.file_name").alias("file")
    sketches.column_sketches(stored, [file]).withColumn("half", F.length("file") % 2).write.parquet(path)
    parts = spark.read.parquet(path)
    assert parts.count() == 4
    merged = sketches.merged_sketches(parts, ["half"])
    assert "data" not in {f.split("/")[-2] for f in merged.inputFiles()}
    again = sketches.merged_sketches(merged)
    assert again.first().rows == 20_000
    by_file = sketches.sketched_profile(parts, rows.schema)
    assert {"file", "half"} <= set(by_file.columns) and by_file.count() == 4 * (len(rows.columns) + 2)


def test_empty_table(spark, rows):
    none = sketches.column_sketches(rows.limit(0))
    lines = sketches.sketched_profile(sketches.merged_sketches(none), rows.schema).collect()
    assert {r.value_count for r in lines} == {0} and {r.lower for r in lines} == {None}
