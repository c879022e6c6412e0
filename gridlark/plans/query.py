"""A registered query: a callable over (session, folder) and the SQL that must agree with it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridlark.operators.results import run_query
from gridlark.sources.tables import attach

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Money has two decimals. Spark sums it as whole cents, which costs less than casting each double to
# a decimal and is exact as well; the sum is a wide decimal, so it cannot overflow.
SPARK_CENTS = "CAST(CAST(rint({0} * 100) AS BIGINT) AS DECIMAL(20,0))"
SPARK_TOTAL = f"CAST(sum({SPARK_CENTS}) / 100 AS DOUBLE)"
DUCK_TOTAL = "CAST(sum(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    oracle: str | None = None
    # The SQL that Spark runs, for queries that are SQL texts.
    text: str | None = None


def named_tables(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def expand(sql: str, total: str) -> str:
    """Write out ``TOTAL(column)`` and ``CENTS(column)``."""
    sql = re.sub(r"TOTAL\((\w+)\)", lambda m: total.format(m[1]), sql)
    return re.sub(r"CENTS\((\w+)\)", lambda m: SPARK_CENTS.format(m[1]), sql)


def sql_query(sql: str, oracle: str | None = None, before: tuple[str, ...] = ()) -> Query:
    """SQL text over the given tables. ``oracle`` defaults to the same text.

    ``before`` holds statements that must have run, such as function definitions. ``{folder}`` in
    the text is the folder of the tables, ``TOTAL(x)`` an exact sum of money.
    """
    text = expand(sql, SPARK_TOTAL)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        attach(spark, folder, named_tables(" ".join((sql, *before))))
        for statement in before:
            run_query(spark, statement)
        return run_query(spark, text.replace("{folder}", folder))

    return Query(run, expand(sql if oracle is None else oracle, DUCK_TOTAL), text)
