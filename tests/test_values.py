"""Value rules: safe, exact, shown as text and as JSON."""

import base64
import json
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridlark.functions.text import checked_name, has_text, stripped, valid_identifier
from gridlark.functions.values import exact_integers, grid_text, json_rows, number_text, sanitize

BROKEN = b"\xff\xfe"


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_plain_values_are_unchanged(spark):
    df = spark.sql("SELECT 1 AS i, 1.5D AS d, 'string' AS s, true AS b, CAST(NULL AS STRING) AS n, DATE '2024-02-29' AS t")
    assert sanitize(df).schema == df.schema
    assert only(sanitize(df)) == only(df)


def test_binary_becomes_text_or_base64(spark):
    df = spark.createDataFrame([(bytearray(b"hello"), bytearray(BROKEN), bytearray(), None)], "a BINARY, b BINARY, c BINARY, d BINARY")
    assert tuple(only(sanitize(df))) == ("hello", "//4=", "", None)


def test_base64_has_no_line_breaks(spark):
    long = BROKEN * 300
    row = only(sanitize(spark.createDataFrame([(bytearray(long),)], "b BINARY")))
    assert row.b == base64.b64encode(long).decode()


def test_nested_binary_and_map_keys(spark):
    ddl = "m MAP<INT, ARRAY<BINARY>>, t STRUCT<a: INT, v: MAP<INT, STRING>>, d MAP<STRING, BINARY>, e STRUCT<b: BINARY>"
    row = ({1: [bytearray(b"hello"), bytearray(BROKEN), None]}, (1, {2: "val"}), {"inner": bytearray(b"world")}, None)
    got = only(sanitize(spark.createDataFrame([row], ddl))).asDict(recursive=True)
    assert got == {
        "m": {"1": ["hello", "//4=", None]},
        "t": {"a": 1, "v": {"2": "val"}},
        "d": {"inner": "world"},
        "e": None,
    }


def test_scalar_map_keys_follow_the_cast(spark):
    got = only(sanitize(spark.sql("SELECT map(true, 1) AS b, map(1e20D, 2) AS d, map(DATE '2024-01-02', 3) AS t")))
    assert got.asDict() == {"b": {"true": 1}, "d": {"1.0E20": 2}, "t": {"2024-01-02": 3}}


def test_binary_map_keys_that_meet_keep_the_last(spark):
    df = spark.sql("SELECT map(X'FFFE', 1, CAST('a' AS BINARY), 2, CAST('//4=' AS BINARY), 3) AS m")
    assert only(sanitize(df)).m == {"a": 2, "//4=": 3}


def test_names_with_dots_and_backticks(spark):
    df = spark.sql("SELECT X'61' AS `a.b`, X'62' AS `c``d`")
    assert tuple(only(sanitize(df))) == ("a", "b")
    assert sanitize(df).columns == ["a.b", "c`d"]


def test_rows_in_rows_become_nested_objects(spark):
    df = spark.sql("SELECT 1 AS id, struct('test' AS inner_str, struct(42 AS val) AS inner_nested) AS nested")
    assert json.loads(only(json_rows(df)).json) == {"id": 1, "nested": {"inner_str": "test", "inner_nested": {"val": 42}}}


def test_json_keeps_nulls_and_wide_numbers(spark):
    df = spark.sql(
        "SELECT CAST(NULL AS INT) AS n, CAST('12345678901234567890' AS DECIMAL(38,0)) AS w, 'NaN'::DOUBLE AS nan, "
        "TIMESTAMP '2024-01-02 03:04:05' AS t, INTERVAL '1' DAY AS i, X'FFFE' AS b"
    )
    got = json.loads(only(json_rows(df)).json)
    assert got["n"] is None and got["w"] == "12345678901234567890" and got["nan"] == "NaN"
    assert got["t"] == "2024-01-02T03:04:05.000000Z" and got["b"] == "//4=" and "1" in got["i"]


def test_large_integers_keep_every_digit(spark):
    df = spark.createDataFrame([(Decimal("12345678901234567890"), 2**62, 7, [2**53 + 1], Decimal("1.5"))],
                               "w DECIMAL(20,0), l BIGINT, i INT, a ARRAY<BIGINT>, d DECIMAL(20,2)")
    row = only(exact_integers(df))
    assert tuple(row) == ("12345678901234567890", str(2**62), 7, [str(2**53 + 1)], Decimal("1.50"))


@pytest.mark.parametrize(
    "value,text",
    [
        (1.0, "1"), (-0.0, "0"), (100.5, "100.5"), (144449.04, "144449.04"), (1e7, "10000000"), (12345678.25, "12345678.25"),
        (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.5e300, "1.5e+300"), (0.001, "0.001"),
        (0.00012, "0.00012"), (1e-6, "0.000001"), (1e-7, "1e-7"), (2.5e-10, "2.5e-10"), (-1e-7, "-1e-7"), (-3.0, "-3"),
    ],
)
def test_numbers_as_a_client_prints_them(spark, value, text):
    assert only(spark.range(1).select(number_text(F.lit(value)).alias("t"))).t == text


def test_grid(spark):
    df = spark.sql("SELECT CAST(NULL AS INT) AS n, 2.0D AS d, true AS b, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS s, "
                   "array(1, 2) AS a, map('k', X'FFFE') AS m, X'68' AS bin, CAST(NULL AS DOUBLE) AS nd")
    assert tuple(only(grid_text(df))) == ("", "2", "true", '{"x":1,"y":null}', "[1,2]", '{"k":"//4="}', "h", "")


def test_nan_is_shown(spark):
    assert only(grid_text(spark.createDataFrame([(math.nan, math.inf)], "a DOUBLE, b DOUBLE"))).a == "NaN"


NAMES = {
    "valid_catalog": True, "a.b.c": True, "valid_name; DROP TABLE foo;": False, "valid_name\n": False,
    "": False, "with space": False, "hy-phen": False, "ünder": False, "A_1": True,
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n STRING")
    assert {r.n: r.v for r in df.select("n", valid_identifier(F.col("n")).alias("v")).collect()} == NAMES
    for name, good in NAMES.items():
        if good:
            assert checked_name("c", name) == f"c.{name}"
        else:
            with pytest.raises(ValueError):
                checked_name("c", name)


BLANKS = ["", " ", "\t\n\r", " ", " 　", "\x1c\x1f", "\x85"]


def test_blank_text_follows_the_server(spark):
    texts = BLANKS + [" x ", "​", "SELECT 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = {r.t: r.v for r in df.select("t", has_text(F.col("t")).alias("v")).collect()}
    assert got == {t: bool(t.strip()) for t in texts}
    assert not only(spark.range(1).select(has_text(F.lit(None).cast("string")).alias("v"))).v


def test_outer_white_space_is_stripped(spark):
    df = spark.createDataFrame([("﻿   a\n b \t　\n",), ("\x85a",)], "t STRING")
    assert [r.s for r in df.select(stripped(F.col("t")).alias("s")).collect()] == ["a\n b", "\x85a"]
