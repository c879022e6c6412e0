"""Plain windows and the split way must agree with brute force, also on one hot key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlark.operators import ordered

PLAIN, SPLIT = 10**9, 7


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    keys = ["hot"] * 60 + ["a"] * 9 + ["b"] * 1 + [None] * 3 + ["c"] * 20
    return [(i, k, rng.randrange(12), rng.randrange(100)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def data(spark, rows):
    return spark.createDataFrame(rows, "id INT, k STRING, x INT, v INT").repartition(4)


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    for members in out.values():
        members.sort(key=lambda r: (r[2], r[0]))
    return out


@pytest.mark.parametrize("limit", [PLAIN, 80, SPLIT])
def test_ranks(data, rows, limit):
    ranked = ordered.ranked(data, ["k"], ["x"], ["id"], limit)
    got = {
        r.id: (r.row_number, r["rank"], r.dense_rank, r.tie_end, r.group_rows, r.nt, r.pr, r.cd)
        for r in ranked.withColumn("nt", ordered.ntile(4))
        .withColumn("pr", ordered.percent_rank())
        .withColumn("cd", ordered.cume_dist())
        .collect()
    }
    assert len(got) == len(rows)
    for members in groups(rows).values():
        n = len(members)
        sizes = [n // 4 + (1 if i < n % 4 else 0) for i in range(4)]
        tiles = [i + 1 for i, size in enumerate(sizes) for _ in range(size)]
        for i, r in enumerate(members):
            less = sum(m[2] < r[2] for m in members)
            upto = sum(m[2] <= r[2] for m in members)
            dense = len({m[2] for m in members if m[2] <= r[2]})
            pr = less / (n - 1) if n > 1 else 0.0
            assert got[r[0]] == (i + 1, less + 1, dense, upto, n, tiles[i], pr, upto / n)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT, 1])
def test_neighbours(data, rows, limit):
    out = ordered.neighbours(
        data,
        ["k"],
        ["x", "id"],
        {
            "prev": ordered.look_back("v"),
            "next2": ordered.look_ahead("v", 2),
            "moving": ordered.look_around(F.sum("v"), -2, 0),
        },
        group_rows=limit,
    )
    got = {r.id: (r.prev, r.next2, r.moving) for r in out.collect()}
    assert len(got) == len(rows)
    for members in groups(rows).values():
        for i, r in enumerate(members):
            prev = members[i - 1][3] if i else None
            next2 = members[i + 2][3] if i + 2 < len(members) else None
            assert got[r[0]] == (prev, next2, sum(m[3] for m in members[max(0, i - 2) : i + 1]))


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
@pytest.mark.parametrize("open_low,open_high", [(False, False), (True, False), (False, True), (True, True)])
def test_range_sums(data, rows, limit, open_low, open_high):
    out = ordered.range_sums(
        data, data, ["k"], ["id"], "x", {"n": F.lit(1), "s": F.col("v")},
        low=F.col("x") - F.col("id") % 4, high=F.when(F.col("id") != 5, F.col("x") + 1 - F.col("id") % 3),
        open_low=open_low, open_high=open_high, group_rows=limit,
    )
    got = {r.id: (r.n, r.s) for r in out.collect()}
    assert len(got) == len(rows)
    for i, k, x, _ in rows:
        lo, hi = x - i % 4, x + 1 - i % 3
        hits = [
            m[3] for m in rows
            if k is not None and m[1] == k and i != 5
            and (m[2] > lo if open_low else m[2] >= lo) and (m[2] < hi if open_high else m[2] <= hi)
        ]
        assert got[i] == (len(hits), sum(hits))


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_range_sums_without_start_and_key(data, rows, limit):
    out = ordered.range_sums(
        data, data, [], ["id"], "x", {"n": F.lit(1)}, high=F.col("x"), open_high=True, group_rows=limit
    )
    got = {r.id: r.n for r in out.collect()}
    assert got == {r[0]: sum(m[2] < r[2] for m in rows) for r in rows}


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_asof(data, rows, limit):
    right = data.where("v % 5 = 0").select("k", F.col("x").alias("rx"), F.col("id").alias("rid"))
    got = {
        r.id: (r.rx, r.rid)
        for r in ordered.asof(data, right, ["k"], ["id"], "x", "rx", ["rx", "rid"], limit).collect()
    }
    assert len(got) == len(rows)
    for i, k, x, _ in rows:
        hits = [(m[2], m[0]) for m in rows if k is not None and m[1] == k and m[3] % 5 == 0 and m[2] <= x]
        assert got[i] == (max(hits) if hits else (None, None))


@pytest.mark.parametrize("limit", [PLAIN, 100, SPLIT])
def test_percentiles(data, rows, limit):
    out = ordered.percentiles(data, ["k"], "v", ["id"], {"p50": 0.5, "p90": 0.9}, limit)
    exact = data.groupBy("k").agg(F.percentile("v", 0.5).alias("p50"), F.percentile("v", 0.9).alias("p90"))
    near = lambda df: {r.k: (round(r.p50, 9), round(r.p90, 9)) for r in df.collect()}
    assert near(out) == near(exact)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_sessions(spark, limit):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"u{i % 5}", start + timedelta(minutes=rng.randrange(20000))) for i in range(300)]
    rows += [("edge", start), ("edge", start + timedelta(hours=1)), ("edge", start + timedelta(hours=1, minutes=59))]
    df = spark.createDataFrame(rows, "u STRING, ts TIMESTAMP")
    got = ordered.sessions(df, ["u"], "ts", 3600, {"n": F.lit(1)}, limit)
    plain = (
        df.groupBy("u", F.session_window("ts", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    )
    as_set = lambda d: {(r.u, r.start, r.last, r.n) for r in d.collect()}
    assert as_set(got) == as_set(plain)
    assert got.count() == plain.count()


ODD = [
    (1, "a", 1.0), (2, "a", float("inf")), (3, "a", float("inf")), (4, "b", float("-inf")), (5, "b", float("inf")),
    (6, "c", None), (7, "c", None), (8, None, 3.0), (9, None, None), (10, "d", float("nan")), (11, "d", 2.0),
    (12, "e", 0.1), *[(20 + i, "hot", float(i % 13)) for i in range(200)],
]


def test_percentiles_of_odd_values(spark):
    """Null keys, keys without values, infinities, NaN and a hot key: one answer on both ways."""
    df = spark.createDataFrame(ODD, "id INT, k STRING, v DOUBLE").repartition(3)
    ways = [
        {r.k: (str(r.p), str(r.q)) for r in ordered.percentiles(df, ["k"], "v", ["id"], {"p": 0.5, "q": 0.9}, n).collect()}
        for n in (PLAIN, SPLIT)
    ]
    assert ways[0] == ways[1] and set(ways[0]) == {"a", "b", "c", None, "d", "e", "hot"}
    assert ways[0]["c"] == ("None", "None") and ways[0]["a"] == ("inf", "inf")


def test_large_sums_of_single_keys(spark):
    """Sums that fit for each key do not overflow over all keys; inexact measures are refused."""
    rows = [(i, f"k{i}", 1, 4 * 10**18) for i in range(6)] + [(9, None, 1, 5)]
    df = spark.createDataFrame(rows, "id INT, k STRING, x INT, v BIGINT")
    for limit in (PLAIN, 2):
        out = ordered.range_sums(df, df, ["k"], ["id"], "x", {"s": F.col("v")}, high=F.col("x"), group_rows=limit)
        assert {r.id: r.s for r in out.collect()} == {i: 4 * 10**18 for i in range(6)} | {9: 0}
        assert out.schema["s"].dataType.simpleString() == "bigint"
        with pytest.raises(TypeError, match="exact"):
            ordered.range_sums(df, df, ["k"], ["id"], "x", {"s": F.col("v") * 0.1}, high=F.col("x"), group_rows=limit)


def test_a_look_knows_its_reach():
    assert (ordered.look_back("v", 3).before, ordered.look_ahead("v", 2).after) == (3, 2)
    wide = ordered.look_around(F.sum("v"), -5, 1)
    assert (wide.before, wide.after) == (5, 1)


def executed(df):
    """The final plan of a frame after it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_one_hot_key_moves_no_other(data, rows):
    """Only the hot key's rows go the second way; without a hot key that way is dropped."""
    out = ordered.neighbours(data, ["k"], ["x", "id"], {"prev": ordered.look_back("v")}, group_rows=30)
    (calm,), (hot,) = ordered._apart(["k"], 30, data)
    assert {r.k for r in hot.collect()} == {"hot"} and {r.k for r in calm.collect()} == {"a", "b", "c", None}
    assert "Union" in executed(out)
    quiet = ordered.neighbours(data, ["k"], ["x", "id"], {"prev": ordered.look_back("v")}, group_rows=PLAIN)
    plan = executed(quiet)
    assert "Union" not in plan and plan.count("Window") < executed(out).count("Window")


def test_parts_are_small_and_in_order(spark):
    df = spark.range(20_000).selectExpr("id", "'k' AS k", "id * 7919 % 20011 AS x")
    parts = ordered._parts(df, ["k"], ["x", "id"], 100).groupBy("_part").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    assert len(parts) > 100 and max(p.n for p in parts) < 2000
    assert all(p.b < q.a for p, q in zip(parts, parts[1:]))


def test_percentiles_of_a_hot_key_sort_few_rows(spark):
    df = spark.range(50_000).selectExpr("id", "id % 2 AS k", "CAST(id * 7919 % 50021 AS DOUBLE) AS v")
    out = ordered.percentiles(df, ["k"], "v", ["id"], {"p": 0.5, "q": 0.99}, group_rows=4000)
    exact = {r.k: (r.p, r.q) for r in df.groupBy("k").agg(F.percentile("v", 0.5).alias("p"), F.percentile("v", 0.99).alias("q")).collect()}
    assert {r.k: (r.p, r.q) for r in out.collect()} == exact
    none = ordered.percentiles(df.limit(0), [], "v", ["id"], {"p": 0.5}, group_rows=10)
    assert [tuple(r) for r in none.collect()] == [(None,)]
    whole = ordered.percentiles(df, [], "v", ["id"], {"p": 0.25}, group_rows=4000)
    assert whole.first().p == df.agg(F.percentile("v", 0.25)).first()[0]


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
@pytest.mark.parametrize("opened", [(False, False), (True, True)])
def test_ranges_of_any_width(spark, limit, opened):
    rng = random.Random(4)
    points = [(rng.choice("ab"), rng.uniform(-50, 50), rng.randrange(9)) for _ in range(150)]
    points += [("a", 3.0, 1)] * 30 + [(None, 1.0, 5), ("a", None, 5)]
    ranges = [(i, rng.choice("abc"), rng.choice([3.0, -1.5, rng.uniform(-60, 60)]), rng.choice([0.0, 0.01, 0.3, 2.0, 40.0, 1e6])) for i in range(60)]
    ranges += [(100, "a", None, 1.0), (101, "a", 1.0, -1.0), (102, None, 0.0, 9.0)]
    left = spark.createDataFrame(ranges, "id INT, k STRING, at DOUBLE, w DOUBLE")
    right = spark.createDataFrame(points, "k STRING, x DOUBLE, v INT")
    out = ordered.wide_range_sums(
        left, right, ["k"], ["id"], "x", {"n": F.lit(1), "s": F.col("v")}, F.col("at") - F.col("w"),
        F.col("at") + F.col("w"), cell=0.25, open_low=opened[0], open_high=opened[1], group_rows=limit,
    )
    got = {r.id: (r.n, r.s) for r in out.collect()}
    assert len(got) == len(ranges)
    for i, k, at, w in ranges:
        hits = [] if at is None else [
            v for key, x, v in points
            if key is not None and key == k and x is not None
            and (x > at - w if opened[0] else x >= at - w) and (x < at + w if opened[1] else x <= at + w)
        ]
        assert got[i] == (len(hits), sum(hits))


def test_wide_ranges_are_not_broadcast(spark, tmp_path):
    """Files of a few kB hold ranges with many slots each; their size on disk says nothing about those."""
    spark.range(300).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS at").coalesce(1).write.parquet(f"{tmp_path}/left")
    spark.range(300).selectExpr("CAST(id AS DOUBLE) AS x").coalesce(1).write.parquet(f"{tmp_path}/right")
    left, right = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("left", "right"))
    at = F.col("at")
    out = ordered.wide_range_sums(left, right, [], ["id"], "x", {"n": F.lit(1)}, at - 1e6, at + 150, cell=0.01)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "_slot" in line]
    assert {r.id: r.n for r in out.collect()} == {i: i % 7 + 151 for i in range(300)}


def test_covers_are_short(spark):
    df = spark.createDataFrame([(a, b) for a in (-9, 0, 5) for b in (5, 6, 77, 10**9, 2**40)], "a LONG, b LONG")
    for r in df.select("a", "b", ordered._cover(F.col("a"), F.col("b")).alias("c")).collect():
        spans = sorted((s.slot << s.level, (s.slot + 1) << s.level) for s in r.c or [])
        assert len(spans) <= 2 * max(1, (r.b - r.a).bit_length() + 1)
        assert [x for x, _ in spans[1:]] == [y for _, y in spans[:-1]]
        assert not spans or (spans[0][0], spans[-1][1]) == (r.a + 1, r.b)
        assert spans or r.b <= r.a + 1
