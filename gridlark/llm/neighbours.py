"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Vectors that are equal are one point, named by its smallest id. Points are first laid in blocks around
a few random pivots, some times over, and get their nearest points of the block as first neighbours.
Then NN-descent: around every point its neighbours, and those that have it as a neighbour, are joined
and compared with each other, so that neighbours of neighbours become neighbours, until a round changes
``SETTLED`` of all edges or less; a descent that does not get there in ``MOST_ROUNDS`` raises. A point that very many others point to is split into several such meetings; none is left out.

Queries walk the graph from their own point: in each round every query opens the nearest points it has
not opened yet and measures their neighbours, until its best points are all open. Distances of the
search are exact, in double precision, on the original vectors; only the graph is built on vectors
rounded to a byte per number.

Defined results: vectors that are null, zero, or hold nulls or non-finite numbers take no part, neither
do rows without id, nor vectors of another length than most have; ties go to the smaller id; with fewer other vectors than asked for, all are found
that the walk reaches; rows with one id and different vectors are points of their own; an empty table
gives no rows; other columns of the input do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.sources.scratch import scratch_path

NEIGHBOURS = 30
# Pivots of a layout: the root of the number of points, and these at least.
PIVOTS = 64
LAYOUTS = 12
BLOCK = 512
# Points of one meeting that come from outside; a point with more of them holds several meetings.
MEETING = 48
# No descent is known to come near this.
MOST_ROUNDS = 50
# Part of the edges below which a round's changes end the descent.
SETTLED = 0.05
# Search: points kept per query, and points opened per query and round.
KEPT = 192
OPENED = 24

Batches = Iterator[pa.RecordBatch]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of float) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("vector"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))


def of_one_length(rows: DataFrame) -> int:
    """The length that most of the vectors have, the smaller one of equals; 0 for an empty table."""
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    return most.length if most else 0


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-sized lists or of binary codes as a float32 matrix."""
    if pa.types.is_binary(column.type):
        rows = [np.frombuffer(b, np.int8) for b in column.to_pylist()]
        return np.stack(rows).astype(np.float32)
    size = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)


def _coded(batches: Batches) -> Batches:
    """Vectors as one byte per number with a factor of their own."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(1))
            factor = np.abs(x).max(axis=1) / 127
            # The smallest numbers there are leave no factor; they are coded as zeros.
            factor[factor == 0] = 1
            codes = np.rint(x / factor[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor.astype(np.float32))],
                names=["id", "codes", "factor"],
            )


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y; the first axes are batches."""
    xx, yy = (x * x).sum(axis=-1), (y * y).sum(axis=-1)
    return np.maximum(xx[..., :, None] + yy[..., None, :] - 2 * (x @ y.swapaxes(-1, -2)), 0)


def _edges(ids: np.ndarray, others: np.ndarray, squares: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(others), pa.array(squares.astype(np.float32))], names=["id", "other", "d"])


EDGE = "id long, other long, d float"


def _layout(points: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    """First neighbours: the nearest ones of blocks of points that lie near the same pivot."""

    def place(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("codes")) * batch.column("factor").to_numpy()[:, None]
                far = _squares(x, pivots)
                near = np.argpartition(far, min(1, far.shape[1] - 1), axis=1)[:, :1].ravel()
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])],
                    names=["id", "codes", "factor", "pivot", "far"],
                )

    def meet(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Batches:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            at = 0
            while at < rows.num_rows:
                # A short rest joins the block before it.
                n = rows.num_rows - at if rows.num_rows - at < 2 * BLOCK else BLOCK
                if n < BLOCK and not last:
                    break
                part = rows.slice(at, n)
                ids = part.column("id").to_numpy()
                x = _matrix(part.column("codes")) * part.column("factor").to_numpy()[:, None]
                d = _squares(x, x)
                np.fill_diagonal(d, np.inf)
                m = min(k, n - 1)
                if m:
                    best = np.argpartition(d, m - 1, axis=1)[:, :m]
                    yield _edges(np.repeat(ids, m), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())
                at += n
            if at < rows.num_rows:
                held.append(rows.slice(at))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 8 * BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    schema = "id long, codes binary, factor float, pivot int, far float"
    placed = points.mapInArrow(place, schema).repartitionByRange("pivot", "far", "id")
    return placed.sortWithinPartitions("pivot", "far", "id").mapInArrow(meet, EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest others of every point."""
    best = edges.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "other"))), 1, k).alias("best"))
    return best.select("id", F.explode("best").alias("b")).select("id", "b.other", "b.d")


def _meetings(batches: Batches) -> Batches:
    """Compares the members of every meeting; rows of a meeting follow each other."""

    def compare(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        host, chunk = rows.column("host").to_numpy(), rows.column("chunk").to_numpy()
        new = np.concatenate([[True], (host[1:] != host[:-1]) | (chunk[1:] != chunk[:-1])])
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        seat = np.arange(len(host)) - starts[group]
        groups, seats = len(starts), int(seat.max()) + 1
        if seats < 2:
            return None
        codes = _matrix(rows.column("codes")) * rows.column("factor").to_numpy()[:, None]
        x = np.zeros((groups, seats, codes.shape[1]), np.float32)
        ids = np.full((groups, seats), -1, np.int64)
        most = np.full((groups, seats), -1.0, np.float32)
        x[group, seat], ids[group, seat] = codes, rows.column("member").to_numpy()
        most[group, seat] = rows.column("most").to_numpy()
        d = _squares(x, x)
        d[(ids[:, None, :] < 0) | np.eye(seats, dtype=bool)] = np.inf
        take = min(NEIGHBOURS, seats)
        best = np.argpartition(d, take - 1, axis=2)[:, :, :take]
        near = np.take_along_axis(d, best, 2)
        g, s, b = np.nonzero((near < most[:, :, None]) & (ids >= 0)[:, :, None])
        return _edges(ids[g, s], ids[g, best[g, s, b]], near[g, s, b])

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*rest, batch]).combine_chunks().to_batches()[0]
        host, chunk = rows.column("host").to_numpy(), rows.column("chunk").to_numpy()
        same = (host == host[-1]) & (chunk == chunk[-1])
        cut = int(np.argmax(same))  # the last meeting may go on in the next batch
        rest = [rows.slice(cut)]
        if cut and (found := compare(rows.slice(0, cut))) is not None:
            yield found
    if rest and (found := compare(rest[0])) is not None:
        yield found


def _descend(graph: DataFrame, points: DataFrame, k: int, number: int) -> DataFrame:
    """Edges that are shorter than a point's longest one, from one round of meetings."""
    to = graph.select(F.col("other").alias("host"), F.col("id").alias("member"))
    size = to.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("chunks"))
    guests = to.join(size, "host").select(
        "host", F.pmod(F.xxhash64("member", F.lit(number)), F.col("chunks")).cast("int").alias("chunk"), "member"
    )
    own = graph.select(F.col("id").alias("host"), F.col("other").alias("member")).join(size, "host", "left")
    chunks = F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)
    hosts = own.select("host", F.explode(chunks).alias("chunk"), "member")
    longest = graph.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(F.lit(float("inf")).cast("float")).alias("most")
    )
    known = points.join(longest, "id").withColumnRenamed("id", "member")
    seated = guests.union(hosts).distinct().join(known, "member").repartition("host", "chunk")
    return seated.sortWithinPartitions("host", "chunk").mapInArrow(_meetings, EDGE)


def build_graph(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Rows of id, other, d for about the k nearest points of every point; ``points``: id, vector."""
    spark, base = points.sparkSession, scratch_path(points.sparkSession, "graph")
    coded = _stored(points.mapInArrow(_coded, "id long, codes binary, factor float"), f"{base}/codes")
    size = coded.count()
    first = None
    for i in range(LAYOUTS):
        picked = coded.orderBy(F.xxhash64("id", F.lit(i)), "id").limit(max(PIVOTS, math.isqrt(size))).select("codes", "factor").collect()
        if not picked:
            return spark.createDataFrame([], EDGE)
        pivots = np.stack([np.frombuffer(r.codes, np.int8).astype(np.float32) * r.factor for r in picked])
        found = _layout(coded, pivots, k)
        first = found if first is None else first.union(found)
    graph = _stored(_best(first, k), f"{base}/0")
    for number in range(1, MOST_ROUNDS + 1):
        found = _descend(graph, coded, k, number)
        better = _stored(_best(graph.union(found), k), f"{base}/{number}")
        changed = better.join(graph, ["id", "other"], "left_anti").count()
        graph = better
        if changed <= SETTLED * k * size:
            return graph
    raise RuntimeError(f"the graph has not settled after {MOST_ROUNDS} rounds: {changed} of {k * size} edges changed")


def _distance(a: str, b: str):
    squares = F.transform(
        F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")),
        lambda p: F.pow(p["a"].cast("double") - p["b"].cast("double"), F.lit(2.0)),
    )
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def search(points: DataFrame, graph: DataFrame, queries: DataFrame, kept: int = KEPT) -> DataFrame:
    """The points nearest to each query that the walk finds: query_id, id, d.

    ``queries``: query_id, start (a point), vector. The start is measured like any other point.
    """
    spark, base = points.sparkSession, scratch_path(points.sparkSession, "walk")
    both = graph.select("id", "other").union(graph.select(F.col("other").alias("id"), F.col("id").alias("other")))
    links = _stored(both.distinct(), f"{base}/links")
    asked = _stored(queries.select("query_id", "start", F.col("vector").alias("asked")), f"{base}/queries")

    def measured(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(points, "id")
            .join(asked.select("query_id", "asked"), "query_id")
            .select("query_id", "id", _distance("vector", "asked").alias("d"), F.lit(False).alias("opened"))
        )

    pool = _stored(measured(asked.select("query_id", F.col("start").alias("id"))), f"{base}/0")
    order = Window.partitionBy("query_id").orderBy("d", "id")
    number = 0
    while True:
        best = pool.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= kept)
        to_open = (
            best.filter(~F.col("opened")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= OPENED)
        )
        to_open = _stored(to_open.select("query_id", "id"), f"{base}/open-{number}")
        if to_open.isEmpty():
            return pool.select("query_id", "id", "d")
        reached = to_open.join(links, "id").select("query_id", F.col("other").alias("id")).distinct()
        fresh = reached.join(pool, ["query_id", "id"], "left_anti")
        marked = pool.join(to_open.withColumn("now", F.lit(True)), ["query_id", "id"], "left").select(
            "query_id", "id", "d", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened")
        )
        number += 1
        pool = _stored(marked.union(measured(fresh)), f"{base}/{number}")


def nearest(vectors: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest rows of ``vectors`` to each row of ``asked``, itself left out.

    Both have vec_id and embedding, and the asked rows are among the vectors. Rows of query_id, rank,
    vec_id, score.
    """
    spark, base = vectors.sparkSession, scratch_path(vectors.sparkSession, "vectors")
    rows = _stored(usable(vectors), f"{base}/rows")
    one_length = F.size("vector") == of_one_length(rows)
    rows = rows.filter(one_length)
    points = _stored(rows.groupBy("vector").agg(F.min("vec_id").alias("id")).select("id", "vector"), f"{base}/points")
    point_of = rows.join(points, "vector").select("vec_id", "id")
    wanted = usable(asked).filter(one_length).join(points, "vector").select(F.col("vec_id").alias("query_id"), F.col("id").alias("start"), "vector")
    found = search(points, build_graph(points), wanted)
    # Of equal vectors the k + 1 smallest ids suffice, one of them may be the query itself.
    small = Window.partitionBy("id").orderBy("vec_id")
    members = point_of.withColumn("m", F.row_number().over(small)).filter(F.col("m") <= k + 1).drop("m")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    nearest_points = found.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id")))
    return (
        nearest_points.filter(F.col("p") <= KEPT)
        .join(members, "id")
        .filter("vec_id != query_id")
        .select("query_id", "vec_id", F.col("d").alias("score"))
        .withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
