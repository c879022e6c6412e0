"""Run registered queries in Spark and their SQL in DuckDB and compare the rows exactly.

``python tests/compare.py [folder] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

from gridlark.plans.query import TABLES  # noqa: E402

DATA = Path("/root/testdata")


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    return type(value).__name__


def bag(columns: list[str], rows: list) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(tuple((kind(r[i]), str(r[i])) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[str, int]:
    """``ok`` or what differs, and the number of Spark rows."""
    rows = df.collect()
    spark_names, spark_bag = bag(df.columns, rows)
    cursor = con.execute(sql)
    names, expected = bag([d[0] for d in cursor.description], cursor.fetchall())
    if spark_names != names:
        return f"columns {spark_names} vs {names}", len(rows)
    if spark_bag != expected:
        extra, lacking = spark_bag - expected, expected - spark_bag
        shown = f"{list(extra)[:2]} vs {list(lacking)[:2]}"
        return f"{sum(extra.values())} extra, {sum(lacking.values())} lacking of {len(rows)}: {shown}", len(rows)
    return "ok", len(rows)


def main(args: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from gridlark.session import get_session

    folder = args[0] if args else str(DATA / "sf0.01")
    spark = get_session(
        "gridlark-compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for key, run in queries().items():
        if args[1:] and key not in args[1:]:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if key in oracles:
                verdict, n = compare(df, con, oracles[key])
            else:
                verdict, n = "rows only", df.count()
        except Exception as e:
            verdict, n = f"{type(e).__name__}: {str(e)[:400]}", 0
        bad += verdict not in ("ok", "rows only")
        print(f"{key:24} {n:8} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
