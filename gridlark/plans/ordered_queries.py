"""Windows, range joins and percentiles, written with the operators that stand a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.ordered import (
    asof,
    cume_dist,
    look_ahead,
    look_around,
    look_back,
    neighbours,
    ntile,
    percent_rank,
    percentiles,
    range_sums,
    ranked,
    sessions,
    wide_range_sums,
)
from gridlark.plans.query import Query
from gridlark.sources.tables import table

HOUR = 3600


def cents(column: str):
    """Money as whole cents, so that sums are exact."""
    return F.rint(F.col(column) * 100).cast("long")


def amount(column: str):
    """Cents back as money."""
    return (F.col(column) / 100).alias(column)


def time_text(column: str):
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def win_rank(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    rows = ranked(orders, ["o_orderpriority"], ["o_orderdate"], ["o_orderkey"])
    return rows.select("o_orderkey", "o_orderpriority", "row_number", "rank", "dense_rank")


WIN_RANK = """
    SELECT o_orderkey, o_orderpriority,
           row_number() OVER (w ORDER BY o_orderdate, o_orderkey) AS row_number,
           rank() OVER (w ORDER BY o_orderdate) AS rank,
           dense_rank() OVER (w ORDER BY o_orderdate) AS dense_rank
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority)
"""


def win_ntile(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = ranked(customers, ["c_mktsegment"], ["c_acctbal"], ["c_custkey"])
    return rows.select(
        "c_custkey",
        ntile(4).alias("quarter"),
        F.round(percent_rank(), 9).alias("percent_rank"),
        F.round(cume_dist(), 9).alias("cume_dist"),
    )


WIN_NTILE = """
    SELECT c_custkey,
           CAST(ntile(4) OVER (w ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quarter,
           round(percent_rank() OVER (w ORDER BY c_acctbal), 9) AS percent_rank,
           round(cume_dist() OVER (w ORDER BY c_acctbal), 9) AS cume_dist
    FROM customer WINDOW w AS (PARTITION BY c_mktsegment)
"""


def win_lag(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = neighbours(
        events,
        ["user_id"],
        ["ts", "event_id"],
        {"before": look_back("event_type"), "after": look_ahead("value", 1, 0.0)},
    )
    return rows.select("event_id", "before", "after")


WIN_LAG = """
    SELECT event_id, lag(event_type) OVER w AS before, lead(value, 1, 0.0) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def win_rows(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    rows = neighbours(
        events,
        ["user_id"],
        ["ts", "event_id"],
        {
            "moving": look_around(F.sum(cents("value")), -2, 0),
            "around": look_around(F.max("value"), -1, 1),
        },
    )
    return rows.select("event_id", amount("moving"), "around")


WIN_ROWS = """
    SELECT event_id,
           CAST(sum(CAST(value AS DECIMAL(18,2)))
                OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving,
           max(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
"""


def win_range(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    rows = range_sums(
        events,
        events,
        ["user_id"],
        ["event_id"],
        "ts",
        {"n": F.lit(1), "total": cents("value")},
        low=F.col("ts") - F.expr("INTERVAL 1 DAY"),
        high=F.col("ts"),
    )
    return rows.select("event_id", "n", amount("total"))


WIN_RANGE = """
    SELECT event_id, count(*) OVER w AS n,
           CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
"""


def win_session(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("ts", "user_id", "value")
    measures = {"n": F.lit(1), "total": cents("value")}
    rows = sessions(events, ["user_id"], "ts", 6 * HOUR, measures)
    return rows.select(
        "user_id",
        time_text("start").alias("start"),
        time_text("last").alias("last"),
        "n",
        amount("total"),
    )


WIN_SESSION = """
    WITH marked AS (
        SELECT user_id, ts, event_id, value,
               CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    ), numbered AS (
        SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM marked
    )
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start,
           strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS n,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM numbered GROUP BY user_id, no
"""


def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    """Per supplier, the customers of its nation with a lower balance."""
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return range_sums(
        suppliers, customers, ["nation"], ["s_suppkey"], "c_acctbal",
        {"poorer": F.lit(1)}, high=F.col("s_acctbal"), open_high=True,
    )


JOIN_THETA = """
    SELECT s_suppkey, count(c_custkey) AS poorer
    FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal
    GROUP BY s_suppkey
"""


def join_range(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, the line items whose unit price lies within two of its retail price."""
    # Positions are cut into slots as wide as a range, so there is a key: a range meets two of them.
    slot = lambda at: F.floor(at / 4)
    low, high = F.col("p_retailprice") - 2, F.col("p_retailprice") + 2
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_retailprice", F.explode_outer(F.sequence(slot(low), slot(high))).alias("slot")
    )
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, folder, "lineitem").select(unit.alias("unit"), "l_quantity", slot(unit).alias("slot"))
    rows = range_sums(
        parts, lines, ["slot"], ["p_partkey"], "unit",
        {"lines": F.lit(1), "quantity": cents("l_quantity")}, low=low, high=high,
    )
    whole = rows.groupBy("p_partkey").agg(F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"))
    return whole.select("p_partkey", "lines", amount("quantity"))


JOIN_RANGE = """
    SELECT p_partkey, count(unit) AS lines,
           CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS quantity
    FROM part LEFT JOIN (SELECT l_extendedprice / l_quantity AS unit, l_quantity FROM lineitem)
         ON unit BETWEEN p_retailprice - 2 AND p_retailprice + 2
    GROUP BY p_partkey
"""


def join_range_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, the line items whose unit price is near its retail price; how near differs a lot.

    The widths go from 0.02 to far beyond all prices.
    """
    reach = F.power(F.lit(1.5), F.col("p_size").cast("double") - 1) / 100
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice", reach.alias("reach"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    lines = table(spark, folder, "lineitem").select(unit.alias("unit"), "l_quantity")
    rows = wide_range_sums(
        parts, lines, [], ["p_partkey"], "unit", {"lines": F.lit(1), "quantity": cents("l_quantity")},
        low=F.col("p_retailprice") - F.col("reach"), high=F.col("p_retailprice") + F.col("reach"), cell=1.0,
    )
    return rows.select("p_partkey", "lines", amount("quantity"))


JOIN_RANGE_WIDE = """
    WITH p AS (SELECT p_partkey, p_retailprice AS price, power(1.5::DOUBLE, p_size::DOUBLE - 1) / 100 AS reach FROM part)
    SELECT p_partkey, count(unit) AS lines,
           CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS quantity
    FROM p LEFT JOIN (SELECT l_extendedprice / l_quantity AS unit, l_quantity FROM lineitem)
         ON unit BETWEEN price - reach AND price + reach
    GROUP BY p_partkey
"""


def join_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Per purchase, the clicks of the same user in the six hours before it."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    bought = events.where("event_type = 'purchase'")
    clicks = events.where("event_type = 'click'")
    rows = range_sums(
        bought, clicks, ["user_id"], ["event_id"], "ts",
        {"clicks": F.lit(1), "worth": cents("value")},
        low=F.col("ts") - F.expr("INTERVAL 6 HOURS"), high=F.col("ts"),
    )
    return rows.select("event_id", "clicks", amount("worth"))


JOIN_INTERVAL = """
    SELECT p.event_id, count(c.event_id) AS clicks,
           CAST(coalesce(sum(CAST(c.value AS DECIMAL(18,2))), 0) AS DOUBLE) AS worth
    FROM events p LEFT JOIN events c
         ON c.user_id = p.user_id AND c.event_type = 'click'
        AND c.ts BETWEEN p.ts - INTERVAL 6 HOURS AND p.ts
    WHERE p.event_type = 'purchase'
    GROUP BY p.event_id
"""


def join_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Per purchase, the user's newest view at or before it."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    bought = events.where("event_type = 'purchase'").drop("event_type")
    views = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id")
    )
    rows = asof(bought, views, ["user_id"], ["event_id"], "ts", "view_ts", ["view_ts", "view_id"])
    return rows.select("event_id", "view_id", time_text("view_ts").alias("view_ts"))


JOIN_ASOF = """
    SELECT p.event_id, v.event_id AS view_id, strftime(v.ts, '%Y-%m-%d %H:%M:%S.%f') AS view_ts
    FROM (SELECT * FROM events WHERE event_type = 'purchase') p
         ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
         ON p.user_id = v.user_id AND p.ts >= v.ts
"""


def agg_percentile(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = percentiles(
        orders, ["o_orderpriority"], "o_totalprice", ["o_orderkey"], {"p25": 0.25, "p50": 0.5, "p95": 0.95}
    )
    return rows.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p95")])


AGG_PERCENTILE = """
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
           round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95
    FROM orders GROUP BY o_orderpriority
"""

QUERIES = {
    "win_rank": Query(win_rank, WIN_RANK),
    "win_ntile": Query(win_ntile, WIN_NTILE),
    "win_lag": Query(win_lag, WIN_LAG),
    "win_rows": Query(win_rows, WIN_ROWS),
    "win_range": Query(win_range, WIN_RANGE),
    "win_session": Query(win_session, WIN_SESSION),
    "join_theta": Query(join_theta, JOIN_THETA),
    "join_range": Query(join_range, JOIN_RANGE),
    "join_range_wide": Query(join_range_wide, JOIN_RANGE_WIDE),
    "join_interval": Query(join_interval, JOIN_INTERVAL),
    "join_asof": Query(join_asof, JOIN_ASOF),
    "agg_percentile": Query(agg_percentile, AGG_PERCENTILE),
}
