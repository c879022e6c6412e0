"""Fixpoints and hierarchies against walks in Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridlark.operators.recursive import fixpoint, hierarchy


def plain_hierarchy(links):
    up = {}
    for node, parent in links:
        if node is not None:
            up[node] = min((p for p in (parent, up.get(node)) if p is not None), default=None)
    found = {}
    for node in up:
        at, depth, seen = node, 0, set()
        while at is not None and up[at] in up and at not in seen:
            seen.add(at)
            at, depth = up[at], depth + 1
        found[node] = (None, None) if at in seen else (at, depth)
    return found


def test_hierarchies(spark):
    rng = random.Random(3)
    links = [(i, rng.choice([None, *range(max(1, i))])) for i in range(1, 120)]
    links += [(200, 201), (201, 202), (202, 200), (203, 200), (300, 300), (400, 999), (5, 1), (5, 2), (None, 3), (1000, 0)]
    links += [(2000 + i, 1000) for i in range(100)]
    df = spark.createDataFrame(links, "node long, parent long")
    got = {r.node: (r.root, r.depth) for r in hierarchy(df).collect()}
    assert got == plain_hierarchy(links)
    assert hierarchy(df.limit(0)).count() == 0


def test_a_path_of_ten_thousand_steps(spark):
    path = spark.range(10_000).selectExpr("concat('n', id) AS child", "if(id > 0, concat('n', id - 1), NULL) AS above")
    found = hierarchy(path, "child", "above")
    assert found.filter("root = 'n0'").agg(F.count("*"), F.max("depth"), F.sum("depth")).first()[:] == (10_000, 9_999, 9_999 * 5_000)


def test_fixpoint_ends_on_cycles(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(None, 1)]
    table = spark.createDataFrame(edges, "a long, b long")
    start = spark.createDataFrame([(0, 0), (None, 0), (0, 3)], "node long, depth int")

    def step(newest):
        return newest.join(table, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("depth") + 1).alias("depth"))

    got = sorted((str(r.node), r.depth) for r in fixpoint(start, step, ["node"]).collect())
    depth, front = {0: 0, None: 0}, {0}
    while front:
        level = max(depth.values()) + 1
        front = {b for a, b in edges if a in front} - set(depth)
        depth |= {n: level for n in front}
    assert got == sorted((str(n), d) for n, d in depth.items())
    with pytest.raises(RuntimeError, match="no fixpoint"):
        fixpoint(start, lambda rows: rows.select((F.col("node") + 1).alias("node"), "depth"), ["node"], most_rounds=3)
