"""Queries that are plain SQL text.

Conventions that keep them sound on large and skewed tables: rows are added up before they meet a
join, so both join sides hold a key once; sums of money are sums of decimals and so do not depend
on the order of addition; lists per key are sets over a small domain.
"""

from __future__ import annotations

from gridlark.plans.query import Query, sql_query

MONEY = "DECIMAL(18,2)"

SCANS = {
    "scan_table": sql_query("SELECT * FROM customer"),
    "scan_file": sql_query(
        """
        SELECT p_brand, p_type, count(*) AS parts, max(p_size) AS largest
        FROM parquet.`{folder}/part.parquet` GROUP BY p_brand, p_type
        """,
        """
        SELECT p_brand, p_type, count(*) AS parts, max(p_size) AS largest
        FROM part GROUP BY p_brand, p_type
        """,
    ),
    "scan_range": sql_query(
        """
        WITH per_day AS (SELECT dayofmonth(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1)
        SELECT id + 1 AS day_of_month, coalesce(n, 0) AS orders
        FROM range(31) LEFT JOIN per_day ON d = id + 1
        """,
        """
        WITH per_day AS (SELECT dayofmonth(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1)
        SELECT t.id + 1 AS day_of_month, coalesce(n, 0) AS orders
        FROM range(31) t(id) LEFT JOIN per_day ON d = t.id + 1
        """,
    ),
    "scan_sample": sql_query(
        """
        WITH sample AS (
            SELECT count(*) AS n, sum(l_quantity) AS quantity
            FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)),
        whole AS (SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem)
        SELECT n AS line_items, abs((SELECT n FROM sample) - 0.1 * n) <= 0.02 * n AS fair_count,
               abs((SELECT quantity FROM sample) - 0.1 * quantity) <= 0.02 * quantity AS fair_sum
        FROM whole
        """,
        "SELECT count(*) AS line_items, TRUE AS fair_count, TRUE AS fair_sum FROM lineitem",
    ),
}

PROJECTIONS = {
    "scan_filter_project": sql_query(
        """
        SELECT l_orderkey, l_linenumber, l_returnflag,
               round(l_extendedprice * (1 - l_discount), 4) AS net
        FROM lineitem
        WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
          AND l_returnflag IN ('A', 'R') AND l_quantity < 25
        """,
    ),
    "cond_exprs": sql_query(
        """
        SELECT o_orderkey,
               CASE WHEN o_totalprice >= 300000 THEN 'high'
                    WHEN o_totalprice >= 100000 THEN 'mid' ELSE 'low' END AS band,
               coalesce(nullif(o_orderstatus, 'F'), 'done') AS state,
               nullif(o_orderpriority, '5-LOW') AS urgent,
               CAST(floor(o_totalprice) AS BIGINT) AS whole,
               CAST(o_custkey AS STRING) AS customer
        FROM orders
        """,
    ),
    "pipe_syntax": sql_query(
        """
        FROM orders
        |> WHERE o_totalprice > 100000
        |> AGGREGATE count(*) AS orders, max(o_totalprice) AS top GROUP BY o_orderstatus, o_orderpriority
        |> WHERE orders > 10
        """,
        """
        SELECT o_orderstatus, o_orderpriority, count(*) AS orders, max(o_totalprice) AS top
        FROM orders WHERE o_totalprice > 100000
        GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 10
        """,
    ),
}

# Revenue per nation. Line items are added up per order, orders per customer, customers per nation:
# each join has unique keys on both sides, whatever one key holds.
STAR = """
    WITH per_order AS (
        SELECT l_orderkey, count(*) AS lines,
               sum(CENTS(l_extendedprice) * (100 - CAST(rint(l_discount * 100) AS INT))) AS revenue
        FROM lineitem GROUP BY l_orderkey
    ), per_customer AS (
        SELECT o_custkey, sum(lines) AS lines, count(*) AS orders, sum(revenue) AS revenue
        FROM per_order JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey
    ), per_nation AS (
        SELECT c_nationkey, sum(lines) AS lines, sum(orders) AS orders, sum(revenue) AS revenue
        FROM per_customer JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey
    )
    SELECT n_name AS nation, r_name AS region, CAST(lines AS BIGINT) AS lines,
           CAST(orders AS BIGINT) AS orders, CAST(CAST(revenue AS DECIMAL(34,0)) / 10000 AS DOUBLE) AS revenue
    FROM per_nation JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
STAR_ORACLE = f"""
    SELECT n_name AS nation, r_name AS region, count(*) AS lines,
           count(DISTINCT o_orderkey) AS orders,
           CAST(sum(CAST(l_extendedprice AS {MONEY}) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)
               AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name
"""

JOINS = {
    "join_star": sql_query(STAR, STAR_ORACLE),
    "join_inner": sql_query(
        """
        SELECT c_mktsegment, o_orderpriority, CAST(sum(n) AS BIGINT) AS orders,
               CAST(sum(total) / 100 AS DOUBLE) AS total
        FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(CENTS(o_totalprice)) AS total
              FROM orders GROUP BY o_custkey, o_orderpriority)
             JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, o_orderpriority
        """,
        """
        SELECT c_mktsegment, o_orderpriority, count(*) AS orders,
               TOTAL(o_totalprice) AS total
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_mktsegment, o_orderpriority
        """,
    ),
    "join_left": sql_query(
        """
        SELECT c_custkey, c_name, coalesce(n, 0) AS orders, total
        FROM customer LEFT JOIN (
            SELECT o_custkey, count(*) AS n, TOTAL(o_totalprice) AS total
            FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 GROUP BY o_custkey
        ) ON c_custkey = o_custkey
        """,
        """
        SELECT c_custkey, c_name, count(o_orderkey) AS orders,
               TOTAL(o_totalprice) AS total
        FROM customer LEFT JOIN orders
             ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000
        GROUP BY c_custkey, c_name
        """,
    ),
    "join_full": sql_query(
        """
        SELECT coalesce(c_custkey, o_custkey) AS custkey, c_acctbal AS balance, coalesce(n, 0) AS big_orders
        FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 1000) c
             FULL OUTER JOIN
             (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY o_custkey) o
             ON c_custkey = o_custkey
        """,
    ),
    "join_semi": sql_query(
        """
        SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN (
            SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000
        ) ON c_custkey = o_custkey
        """,
        """
        SELECT c_custkey, c_name FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000)
        """,
    ),
    "join_anti": sql_query(
        """
        SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN (
            SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000
        ) ON c_custkey = o_custkey
        """,
        """
        SELECT c_custkey, c_name FROM customer
        WHERE NOT EXISTS (SELECT 1 FROM orders
                          WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)
        """,
    ),
}

# Rows are added up per full group once; only those few sums are multiplied into grouping sets.
PRICE_GROUPS = """
    WITH sums AS (
        SELECT l_returnflag, l_linestatus, count(*) AS n, {cents} AS q
        FROM lineitem GROUP BY l_returnflag, l_linestatus
    )
    SELECT l_returnflag, l_linestatus, {extra}
           CAST(sum(n) AS BIGINT) AS lines, CAST(sum(q) / 100 AS DOUBLE) AS quantity
    FROM sums GROUP BY {groups}
"""
PRICE_GROUPS_ORACLE = """
    SELECT l_returnflag, l_linestatus, {extra} count(*) AS lines, TOTAL(l_quantity) AS quantity
    FROM lineitem GROUP BY {groups}
"""
GROUPING = "CAST(grouping(l_returnflag) AS INT) AS all_flags, CAST(grouping(l_linestatus) AS INT) AS all_status,"

HASH_SUMS = """
    SELECT l_returnflag, l_linestatus, count(*) AS lines, TOTAL(l_quantity) AS sum_qty,
           TOTAL(l_extendedprice) AS sum_base, {discounted} AS sum_disc,
           round(avg(l_discount), 6) AS avg_disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
    GROUP BY l_returnflag, l_linestatus
"""


def grouped(groups: str) -> Query:
    return sql_query(
        PRICE_GROUPS.format(cents="sum(CENTS(l_quantity))", extra=GROUPING, groups=groups),
        PRICE_GROUPS_ORACLE.format(extra=GROUPING, groups=groups),
    )


AGGREGATES = {
    "agg_hash": sql_query(
        HASH_SUMS.format(discounted="CAST(sum(CENTS(l_extendedprice) * (100 - CAST(rint(l_discount * 100) AS INT))) / 10000 AS DOUBLE)"),
        HASH_SUMS.format(
            discounted="CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"
        ),
    ),
    "agg_distinct": sql_query(
        """
        SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
        FROM lineitem GROUP BY l_returnflag
        """,
    ),
    "agg_cube": grouped("CUBE (l_returnflag, l_linestatus)"),
    "agg_rollup": grouped("ROLLUP (l_returnflag, l_linestatus)"),
    "agg_gsets": grouped("GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    "agg_having": sql_query(
        """
        SELECT o_custkey, count(*) AS orders, TOTAL(o_totalprice) AS total
        FROM orders GROUP BY o_custkey HAVING count(*) > 12
        """,
    ),
    "agg_filter": sql_query(
        """
        SELECT o_orderpriority, count(*) AS orders,
               count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
               max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top_open
        FROM orders GROUP BY o_orderpriority
        """,
    ),
    "agg_pivot": sql_query(
        f"""
        SELECT yr, CAST(F AS DOUBLE) AS f, CAST(O AS DOUBLE) AS o, CAST(P AS DOUBLE) AS p
        FROM (SELECT year(o_orderdate) AS yr, o_orderstatus, CAST(o_totalprice AS {MONEY}) AS price FROM orders)
        PIVOT (sum(price) FOR o_orderstatus IN ('F', 'O', 'P'))
        """,
        f"""
        SELECT CAST(year(o_orderdate) AS INTEGER) AS yr,
               CAST(sum(CAST(o_totalprice AS {MONEY})) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS f,
               CAST(sum(CAST(o_totalprice AS {MONEY})) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS o,
               CAST(sum(CAST(o_totalprice AS {MONEY})) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS p
        FROM orders GROUP BY 1
        """,
    ),
    "agg_unpivot": sql_query(
        """
        SELECT p_partkey, measure, value
        FROM (SELECT p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part)
        UNPIVOT (value FOR measure IN (price, size))
        """,
        """
        SELECT p_partkey, 'price' AS measure, p_retailprice AS value FROM part
        UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part
        """,
    ),
    # Estimates next to what they estimate: distinct parts, and how many lines lie below the median.
    "agg_approx": sql_query(
        """
        WITH estimates AS (
            SELECT l_returnflag AS flag, approx_count_distinct(l_partkey, 0.02) AS parts,
                   percentile_approx(l_quantity, 0.5, 1000) AS middle
            FROM lineitem GROUP BY l_returnflag
        )
        SELECT l_returnflag, count(*) AS line_items,
               abs(max(parts) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS close_count,
               count_if(l_quantity < middle) <= 0.501 * count(*) AND count_if(l_quantity <= middle) >= 0.499 * count(*)
                   AS close_median
        FROM lineitem JOIN estimates ON l_returnflag = flag GROUP BY l_returnflag
        """,
        """
        SELECT l_returnflag, count(*) AS line_items, TRUE AS close_count, TRUE AS close_median
        FROM lineitem GROUP BY l_returnflag
        """,
    ),
    # A set per key, added up map-side: it holds each priority once, however many orders there are.
    "agg_collect": sql_query(
        """
        SELECT o_custkey, array_join(sort_array(collect_set(o_orderpriority)), '|') AS priorities
        FROM orders GROUP BY o_custkey
        """,
        """
        SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities
        FROM orders GROUP BY o_custkey
        """,
    ),
}

TOPN = """
    SELECT c_nationkey, c_custkey, c_acctbal, CAST(place AS INT) AS place FROM (
        SELECT c_nationkey, c_custkey, c_acctbal,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place
        FROM customer) ranked
    WHERE place <= 3
"""

ORDERING = {
    # Each task cuts a nation to its own first three before rows are shuffled.
    "win_topn": sql_query(TOPN),
    "topk": sql_query(
        "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
    ),
    "limit_offset": sql_query(
        """
        SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40
        """,
    ),
}

BIG = "SELECT o_custkey AS custkey FROM orders WHERE o_totalprice > 400000"
LATE = "SELECT o_custkey AS custkey FROM orders WHERE o_orderdate >= DATE '2001-01-01'"
# Spark joins the two sides of INTERSECT and EXCEPT; made distinct first, no key is hot in it.
BIG_ONCE, LATE_ONCE = (side.replace("SELECT", "SELECT DISTINCT", 1) for side in (BIG, LATE))

SETS = {
    "set_union": sql_query(f"{BIG} UNION {LATE}"),
    "set_union_all": sql_query(f"{BIG} UNION ALL {LATE}"),
    "set_intersect": sql_query(f"{BIG_ONCE} INTERSECT {LATE_ONCE}"),
    "set_except": sql_query(f"{BIG_ONCE} EXCEPT {LATE_ONCE}"),
    "set_except_all": sql_query(f"{LATE} EXCEPT ALL {BIG}"),
}

SUBQUERIES = {
    "sub_cte": sql_query(
        """
        WITH per_customer AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
             spread AS (SELECT n, count(*) AS customers FROM per_customer GROUP BY n)
        SELECT n AS orders, customers FROM spread WHERE n > (SELECT min(n) FROM spread)
        """,
    ),
    "sub_corr": sql_query(
        """
        SELECT c_custkey,
               (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS top,
               (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big
        FROM customer
        """,
    ),
    "sub_exists": sql_query(
        """
        SELECT c_custkey, c_mktsegment FROM customer
        WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) b
                      WHERE b.o_custkey = c_custkey)
        """,
    ),
    # NOT IN drops everything if the set has a null, and a null key unless the set is empty. Spelled out, because NOT IN itself sends the whole set to
    # every task whatever its size.
    "sub_notin": sql_query(
        """
        SELECT p_partkey, p_name FROM part
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) s
                          WHERE s.l_partkey = p_partkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NULL)
          AND (p_partkey IS NOT NULL OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity > 45))
        """,
        """
        SELECT p_partkey, p_name FROM part
        WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
        """,
    ),
    "sub_lateral": sql_query(
        """
        SELECT c_custkey, t.orders, t.top FROM customer,
               LATERAL (SELECT count(*) AS orders, max(o_totalprice) AS top
                        FROM orders WHERE o_custkey = c_custkey) AS t
        """,
    ),
    # The walk covers the world, regions and nations. Customers are counted once, per nation, and
    # meet the finished tree, so no step of the walk grows with their number.
    "cte_recursive": sql_query(
        """
        WITH RECURSIVE edges AS (
            SELECT 'world' AS parent, concat('r', r_regionkey) AS child, r_name AS label FROM region
            UNION ALL
            SELECT concat('r', n_regionkey), concat('n', n_nationkey), n_name FROM nation
        ), tree(node, path, depth) AS (
            SELECT 'world', 'world', 0
            UNION ALL
            SELECT child, concat(path, '/', label), depth + 1 FROM tree JOIN edges ON parent = node
        ), counts AS (
            SELECT concat('n', c_nationkey) AS leaf, count(*) AS n FROM customer GROUP BY c_nationkey
        )
        SELECT path, depth, coalesce(n, 0) AS customers FROM tree LEFT JOIN counts ON leaf = node
        """,
    ),
}

FUNCTIONS = {
    "fn_string": sql_query(
        """
        SELECT p_partkey, upper(p_name) AS up, length(p_name) AS size, substring(p_name, 2, 4) AS piece,
               replace(p_brand, '#', '-') AS brand, concat(p_brand, '/', p_type) AS kind,
               lpad(CAST(p_size AS STRING), 4, '0') AS padded, trim(concat('  ', p_type, ' ')) AS bare,
               split_part(p_name, ' ', 2) AS noun
        FROM part
        """,
        """
        SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS size,
               substring(p_name, 2, 4) AS piece, replace(p_brand, '#', '-') AS brand,
               concat(p_brand, '/', p_type) AS kind, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
               trim(concat('  ', p_type, ' ')) AS bare, split_part(p_name, ' ', 2) AS noun
        FROM part
        """,
    ),
    "fn_regexp": sql_query(
        r"""
        SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#')) AS masked,
               regexp_extract(source, '([a-z]+)', 1) AS kind
        FROM documents
        """,
        r"""
        SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked,
               regexp_extract(source, '([a-z]+)', 1) AS kind
        FROM documents
        """,
    ),
    "fn_date": sql_query(
        """
        SELECT o_orderkey, year(o_orderdate) AS yr, month(o_orderdate) AS mon,
               date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS month_start,
               date_format(o_orderdate, 'dd/MM/yyyy') AS shown,
               datediff(o_orderdate, DATE '1995-01-01') AS days
        FROM orders
        """,
        """
        SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(month(o_orderdate) AS INTEGER) AS mon,
               strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
               strftime(o_orderdate, '%d/%m/%Y') AS shown,
               CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days
        FROM orders
        """,
    ),
    "fn_math": sql_query(
        """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice, 0) AS rounded,
               CAST(floor(l_extendedprice) AS BIGINT) AS lower, CAST(ceil(l_extendedprice) AS BIGINT) AS upper,
               round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS log,
               power(l_quantity, 2) AS square, abs(l_linenumber - 4) AS off, l_orderkey % 7 AS rest
        FROM lineitem
        """,
    ),
    "fn_array": sql_query(
        """
        SELECT vec_id, size(embedding) AS dims, array_max(embedding) AS top,
               round(aggregate(embedding, CAST(0 AS DOUBLE),
                               (acc, x) -> acc + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 6) AS norm,
               size(filter(embedding, x -> x > 0)) AS positive
        FROM embeddings
        """,
        """
        SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, list_max(embedding) AS top,
               round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6)
                   AS norm,
               CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive
        FROM embeddings
        """,
    ),
    "fn_explode": sql_query(
        """
        SELECT pos, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 6) AS total, max(x) AS top
        FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, x GROUP BY pos
        """,
        """
        SELECT CAST(pos AS INTEGER) AS pos, count(*) AS n, round(sum(CAST(x AS DOUBLE)), 6) AS total, max(x) AS top
        FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
        GROUP BY pos
        """,
    ),
    "fn_map": sql_query(
        """
        SELECT o_orderkey, array_join(map_keys(m), ',') AS names, element_at(m, 'status') AS status,
               element_at(m, 'none') AS missing, cardinality(m) AS entries
        FROM (SELECT o_orderkey, map('status', o_orderstatus, 'priority', o_orderpriority) AS m FROM orders)
        """,
        """
        SELECT o_orderkey, 'status,priority' AS names, o_orderstatus AS status,
               CAST(NULL AS VARCHAR) AS missing, CAST(2 AS INTEGER) AS entries
        FROM orders
        """,
    ),
    "fn_json": sql_query(
        """
        SELECT event_id, get_json_object(props, '$.k') AS k_text, from_json(props, 'k INT').k AS k,
               get_json_object(props, '$.none') AS missing
        FROM events
        """,
        """
        SELECT event_id, json_extract_string(props, '$.k') AS k_text,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               json_extract_string(props, '$.none') AS missing
        FROM events
        """,
    ),
    "fn_collate": sql_query(
        """
        SELECT lower(name) COLLATE UTF8_BINARY AS name, n FROM (
            SELECT name COLLATE UTF8_LCASE AS name, count(*) AS n
            FROM (SELECT upper(p_type) AS name FROM part UNION ALL SELECT lower(p_type) FROM part)
            GROUP BY name COLLATE UTF8_LCASE)
        """,
        "SELECT lower(p_type) AS name, 2 * count(*) AS n FROM part GROUP BY lower(p_type)",
    ),
}

SPARK_TIME = "'yyyy-MM-dd HH:mm:ss'"

TIME_WINDOWS = {
    "win_tumbling": sql_query(
        f"""
        SELECT date_format(w.start, {SPARK_TIME}) AS start, event_type, count(*) AS n,
               TOTAL(value) AS total
        FROM (SELECT window(ts, '1 day') AS w, event_type, value FROM events) GROUP BY w, event_type
        """,
        """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n,
               TOTAL(value) AS total
        FROM events GROUP BY 1, 2
        """,
    ),
    "win_sliding": sql_query(
        f"""
        SELECT date_format(w.start, {SPARK_TIME}) AS start, count(*) AS n,
               TOTAL(value) AS total
        FROM (SELECT window(ts, '2 days', '1 day') AS w, value FROM events) GROUP BY w
        """,
        """
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n,
               TOTAL(value) AS total
        FROM (SELECT date_trunc('day', ts) AS s, value FROM events
              UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, value FROM events)
        GROUP BY s
        """,
    ),
}

USER_FUNCTIONS = {
    "udf_sql": sql_query(
        "SELECT o_orderkey, gridlark_band(o_totalprice) AS band FROM orders",
        """
        SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 300000 THEN 3 WHEN o_totalprice >= 100000 THEN 2
                                ELSE 1 END AS INTEGER) AS band
        FROM orders
        """,
        before=(
            """
            CREATE OR REPLACE TEMPORARY FUNCTION gridlark_band(price DOUBLE) RETURNS INT
            RETURN CASE WHEN price >= 300000 THEN 3 WHEN price >= 100000 THEN 2 ELSE 1 END
            """,
        ),
    ),
    "udtf_sql": sql_query(
        """
        SELECT n_name, t.segment, t.customers FROM nation, LATERAL gridlark_segments(n_nationkey) AS t
        """,
        """
        SELECT n_name, c_mktsegment AS segment, count(*) AS customers
        FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name, c_mktsegment
        """,
        before=(
            """
            CREATE OR REPLACE TEMPORARY FUNCTION gridlark_segments(nation_id INT)
            RETURNS TABLE(segment STRING, customers BIGINT)
            RETURN SELECT c_mktsegment, count(*) FROM customer WHERE c_nationkey = nation_id GROUP BY c_mktsegment
            """,
        ),
    ),
}

QUERIES: dict[str, Query] = {
    **SCANS,
    **PROJECTIONS,
    **JOINS,
    **AGGREGATES,
    **ORDERING,
    **SETS,
    **SUBQUERIES,
    **FUNCTIONS,
    **TIME_WINDOWS,
    **USER_FUNCTIONS,
}
