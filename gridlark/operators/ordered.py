"""Ordered operators that hold when one key owns a large share of all rows.

A window function sorts every row of a key in one task. That is the right plan for keys of at most
``group_rows`` rows. Keys with more are found by counting inside the plan, and go another way, alone:

1. Splitters are rows that a hash of the order picks, one in some millions. There are so few that they
   are sent to all tasks, where every row of a hot key finds by binary search between which two it
   belongs: that is its part.
2. A row's position in its key is its number in its part plus the rows of all parts before.
3. Positions are cut into blocks of ``group_rows`` rows; windows run per block, and what a block needs
   from others is carried over: copies of a few neighbouring rows, or one summary row per block.

Both ways are one lazy plan; building it runs no job. Parts follow from the data alone, so a stage that
is computed again after a loss gives the same positions. Where no key is hot, the second way reads
nothing: adaptive execution drops it once the count is known.

The order must be total (end it with a unique column): rows that are alike in all of it share a part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one key that a single task may sort.
GROUP_ROWS = 5_000_000

# Parts for each ``group_rows`` rows. Parts differ in size; with four, few are larger than a block.
PARTS = 4

@dataclass(frozen=True)
class Look:
    """A window expression and how many rows it sees before and after its own."""

    make: Callable[[WindowSpec], Column]
    before: int
    after: int


def look_back(column: str, rows: int = 1, default=None) -> Look:
    """``lag``: the value ``rows`` rows earlier."""
    return Look(lambda w: F.lag(column, rows, default).over(w), rows, 0)


def look_ahead(column: str, rows: int = 1, default=None) -> Look:
    """``lead``: the value ``rows`` rows later."""
    return Look(lambda w: F.lead(column, rows, default).over(w), 0, rows)


def look_around(aggregate: Column, start: int, end: int) -> Look:
    """An aggregate over the ROWS frame from ``start`` to ``end``, both counted from the own row."""
    return Look(lambda w: aggregate.over(w.rowsBetween(start, end)), max(0, -start), max(0, end))


def _limit(group_rows: int | None) -> int:
    return GROUP_ROWS if group_rows is None else group_rows


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows without a key get one that all share; it is computed, so that joins on it stay equi joins."""
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.pmod(F.xxhash64(*df.columns), F.lit(1).cast("long"))), ["_all"]


def _same(keys: Sequence[str], prefix: str) -> Column:
    """Keys equal to the columns with a prefix; null equals null."""
    found = F.lit(True)
    for i, k in enumerate(keys):
        found = found & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return found


def _renamed(keys: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def _apart(keys: Sequence[str], group_rows: int, *inputs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each input without the hot keys, and with the hot keys alone.

    A key is hot that has more than ``group_rows`` rows over all inputs together. Hot keys number one
    for each ``group_rows`` rows at most, so they are sent to all tasks.
    """
    rows = inputs[0].select(*keys)
    for df in inputs[1:]:
        rows = rows.unionAll(df.select(*keys))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > group_rows)
    hot = F.broadcast(counts.select(*_renamed(keys, "_hot")))
    same = _same(keys, "_hot")
    return [df.join(hot, same, "left_anti") for df in inputs], [df.join(hot, same, "left_semi") for df in inputs]


def _place(bounds: Column, row: Column) -> Column:
    """How many of the sorted bounds are not above the row, by binary search."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))

    def step(found: Column, _: Column) -> Column:
        middle = F.floor((found["low"] + found["high"]) / 2).cast("int")
        under = (found["low"] < found["high"]) & F.coalesce(F.get(bounds, middle) <= row, F.lit(False))
        return F.struct(
            F.when(under, middle + 1).otherwise(found["low"]).alias("low"),
            F.when(under | (found["low"] >= found["high"]), found["high"]).otherwise(middle).alias("high"),
        )

    return F.when(bounds.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, step, lambda f: f["low"]))


def _parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Rows with ``_part``: parts of a key follow each other in the order and hold about ``size`` rows."""
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    picked = df.where(F.pmod(F.xxhash64(row), F.lit(max(1, size)).cast("long")) == 0)
    bounds = picked.groupBy(*_renamed(keys, "_at")).agg(F.sort_array(F.collect_list(row)).alias("_bounds"))
    # One splitter for each ``size`` rows of the hot keys.
    spread = df.join(F.broadcast(bounds), _same(keys, "_at"), "left")
    return spread.select(*df.columns, _place(F.col("_bounds"), row).alias("_part"))


def _starts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per part: how many rows of the key come before it, and how many it has."""
    sizes = parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *_renamed(keys, "_of"),
        F.col("_part").alias("_number"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        "_rows",
    )


def _numbered(parts: DataFrame, starts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``_pos``, their place in the key from 0."""
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = parts.withColumn("_in", F.row_number().over(inside))
    same = _same(keys, "_of") & (F.col("_part") == F.col("_number"))
    return rows.join(starts, same).withColumn("_pos", F.col("_start") + F.col("_in") - 1)


def _blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """All rows with ``_pos``, their place in the key, and ``_block``."""
    parts = _parts(df, keys, order, size // PARTS)
    placed = _numbered(parts, _starts(parts, keys), keys, order)
    return placed.select(*df.columns, "_pos", F.floor(F.col("_pos") / F.lit(size)).alias("_block"))


def _with_halo(blocks: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Copy the rows near a block edge into the next or previous block as well.

    ``_own`` tells a block's own rows from copies.
    """
    offset = F.col("_pos") % F.lit(size)
    copies = [F.struct(F.col("_block").alias("b"), F.lit(True).alias("own"))]
    reach = lambda cond, step: F.when(
        cond, F.struct((F.col("_block") + F.lit(step)).alias("b"), F.lit(False).alias("own"))
    )
    for step in range(1, -(-before // size) + 1):
        copies.append(reach(offset >= F.lit(size * step - before), step))
    for step in range(1, -(-after // size) + 1):
        copies.append(reach(offset < F.lit(after - size * (step - 1)), -step))
    seats = F.filter(F.array(*copies), lambda s: s.isNotNull())
    spread = blocks.withColumn("_seat", F.explode(seats))
    return spread.withColumn("_block", F.col("_seat.b")).withColumn("_own", F.col("_seat.own")).drop("_seat")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    looks: dict[str, Look],
    group_rows: int | None = None,
) -> DataFrame:
    """Add what rows see of their neighbours: ``lag``, ``lead`` and ROWS frames.

    Each look carries its reach, so no row can ask for more than is copied over block edges.
    """
    group_rows, columns = _limit(group_rows), df.columns
    df, keys = _keyed(df, keys)
    (calm,), (hot,) = _apart(keys, group_rows, df)
    both = _calm_neighbours(calm, keys, order, looks).unionAll(_hot_neighbours(hot, keys, order, looks, group_rows))
    return both.select(*columns, *looks)


def _calm_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], looks: dict[str, Look]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", *[look.make(window).alias(name) for name, look in looks.items()])


def _hot_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], looks: dict[str, Look], group_rows: int
) -> DataFrame:
    before = max(look.before for look in looks.values())
    after = max(look.after for look in looks.values())
    spread = _with_halo(_blocks(df, keys, order, group_rows), group_rows, before, after)
    window = Window.partitionBy(*keys, "_block").orderBy("_pos")
    done = spread.select("*", *[look.make(window).alias(name) for name, look in looks.items()])
    return done.where("_own").select(*df.columns, *looks)


def _scan(keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """Windows over a key's block summaries: all earlier blocks, all later blocks.

    They see one row per ``group_rows`` rows of data. Looking ahead is looking back in descending
    order: a frame that ends at the last row would be computed anew for every row.
    """
    strictly_before = (Window.unboundedPreceding, -1)
    key = Window.partitionBy(*keys)
    return (
        key.orderBy("_block").rowsBetween(*strictly_before),
        key.orderBy(F.desc("_block")).rowsBetween(*strictly_before),
    )


def _inside(keys: Sequence[str]) -> tuple[WindowSpec, WindowSpec]:
    """Windows inside a block: up to the current row, and from it onward."""
    block = Window.partitionBy(*keys, "_block")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    return block.orderBy("_pos").rowsBetween(*so_far), block.orderBy(F.desc("_pos")).rowsBetween(*so_far)


def _carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows next to their block's carried values; ``carry`` has the keys, ``_block`` and values."""
    values = [c for c in carry.columns if c not in keys and c != "_block"]
    named = carry.select(*_renamed(keys, "_from"), F.col("_block").alias("_from_block"), *values)
    return rows.join(named, _same(keys, "_from") & (F.col("_block") == F.col("_from_block")))


RANKS = ("row_number", "rank", "dense_rank", "tie_end", "group_rows")


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    unique: Sequence[str],
    group_rows: int | None = None,
) -> DataFrame:
    """Ranks inside each key: ``row_number, rank, dense_rank, tie_end, group_rows``.

    ``by`` decides ties (ascending, nulls first), ``unique`` makes the order total. ``tie_end`` is
    the number of rows up to and including the row's ties.
    """
    group_rows, columns = _limit(group_rows), df.columns
    df, keys = _keyed(df, keys)
    (calm,), (hot,) = _apart(keys, group_rows, df)
    both = _calm_ranks(calm, keys, by, unique).unionAll(_hot_ranks(hot, keys, by, unique, group_rows))
    return both.select(*columns, *RANKS)


def _calm_ranks(df: DataFrame, keys: Sequence[str], by: Sequence[str], unique: Sequence[str]) -> DataFrame:
    total = Window.partitionBy(*keys).orderBy(*by, *unique)
    ties = Window.partitionBy(*keys).orderBy(*by)
    whole = Window.partitionBy(*keys)
    return df.select(
        "*",
        F.row_number().over(total).cast("long").alias("row_number"),
        F.rank().over(ties).cast("long").alias("rank"),
        F.dense_rank().over(ties).cast("long").alias("dense_rank"),
        F.count(F.lit(1)).over(ties).alias("tie_end"),
        F.count(F.lit(1)).over(whole).alias("group_rows"),
    )


def _hot_ranks(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], unique: Sequence[str], group_rows: int
) -> DataFrame:
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(by)])
    edge = Window.partitionBy(*keys, "_block").orderBy("_pos")
    # First and last rows of ties, seen across block edges through one copied row.
    marked = _with_halo(_blocks(df, keys, [*by, *unique], group_rows), group_rows, 1, 1).withColumns(
        {"_first": ~tie.eqNullSafe(F.lag(tie).over(edge)), "_last": ~tie.eqNullSafe(F.lead(tie).over(edge))}
    )
    upto, onward = _inside(keys)
    pos_if = lambda flag: F.when(F.col(flag), F.col("_pos"))
    marked = marked.where("_own").withColumns(
        {
            "_ties": F.sum(F.col("_first").cast("long")).over(upto),
            "_ts": F.max(pos_if("_first")).over(upto),
            "_te": F.min(pos_if("_last")).over(onward),
        }
    )
    per_block = marked.groupBy(*keys, "_block").agg(
        F.max("_ties").alias("ties"), F.max("_ts").alias("ts"), F.min("_te").alias("te"), F.max("_pos").alias("end")
    )
    earlier, later = _scan(keys)
    carry = per_block.select(
        *keys,
        "_block",
        F.coalesce(F.sum("ties").over(earlier), F.lit(0)).alias("_ties0"),
        F.max("ts").over(earlier).alias("_ts0"),
        F.min("te").over(later).alias("_te0"),
        F.max("end").over(Window.partitionBy(*keys)).alias("_end"),
    )
    return _carried(marked, carry, keys).select(
        *df.columns,
        (F.col("_pos") + 1).alias("row_number"),
        (F.coalesce("_ts", "_ts0") + 1).alias("rank"),
        (F.col("_ties") + F.col("_ties0")).alias("dense_rank"),
        (F.coalesce("_te", "_te0") + 1).alias("tie_end"),
        (F.col("_end") + 1).alias("group_rows"),
    )


def ntile(buckets: int) -> Column:
    """Bucket number of a ranked row; the first buckets take the remainder."""
    n, row = F.col("group_rows"), F.col("row_number")
    small, extra = F.floor(n / buckets), n % buckets
    long_part = extra * (small + 1)
    return (
        F.when(row <= long_part, F.ceil(row / (small + 1)))
        .otherwise(extra + F.ceil((row - long_part) / small))
        .cast("int")
    )


def percent_rank() -> Column:
    n = F.col("group_rows")
    return F.when(n > 1, (F.col("rank") - 1) / (n - 1)).otherwise(F.lit(0.0))


def cume_dist() -> Column:
    return F.col("tie_end") / F.col("group_rows")


def percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    unique: Sequence[str],
    points: dict[str, float],
    group_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated percentiles per key; a key without any value keeps its row, with nulls.

    Spark's ``percentile`` keeps the distinct values of a key in memory, so it serves for keys of a
    tenth of ``group_rows`` at most. A larger key's values are only counted into parts between
    splitters; the parts that hold the wanted ranks are found from the counts, and no other rows are
    sorted or shuffled. Values are interpolated by the same formula: equal neighbours as they are, NaN
    as the largest value.
    """
    few, names = max(1, _limit(group_rows) // 10), list(keys)
    df, keys = _keyed(df.select(*dict.fromkeys([*keys, value, *unique])), keys)
    (calm,), (hot,) = _apart(keys, few, df)
    plain = calm.groupBy(*keys).agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in points.items()])
    both = plain.unionAll(_hot_percentiles(hot, keys, value, unique, points, few))
    if names:
        return both
    # An empty table without keys has one row of nulls.
    return both.agg(*[F.max(name).alias(name) for name in points])


def _hot_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, unique: Sequence[str], points: dict[str, float], few: int
) -> DataFrame:
    order = [value, *unique]
    parts = _parts(df.where(F.col(value).isNotNull()), keys, order, few // PARTS)
    starts = _starts(parts, keys)
    of = [f"_of{i}" for i in range(len(keys))]
    totals = starts.withColumn("_all_rows", F.sum("_rows").over(Window.partitionBy(*of)))
    # Each point needs the values at one or two places.
    spots = F.array(*[(F.col("_all_rows") - 1) * F.lit(p) for p in points.values()])
    places = F.array_distinct(F.flatten(F.array(F.transform(spots, lambda s: F.floor(s)), F.transform(spots, lambda s: F.ceil(s)))))
    here = lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_rows"))
    wanted = totals.withColumn("_wanted", F.filter(places, here)).where(F.size("_wanted") > 0)
    same = _same(keys, "_of") & (F.col("_part") == F.col("_number"))
    # A hot key has two rows for each point here at most.
    near = parts.join(F.broadcast(wanted), same)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    found = near.withColumn("_pos", F.col("_start") + F.row_number().over(inside) - 1).where(
        F.array_contains("_wanted", F.col("_pos"))
    )
    chosen = []
    for name, p in points.items():
        spot = (F.col("_all_rows") - 1) * F.lit(p)
        below, above = F.floor(spot), F.ceil(spot)
        low = F.max(F.when(F.col("_pos") == below, F.col(value).cast("double")))
        high = F.max(F.when(F.col("_pos") == above, F.col(value).cast("double")))
        between = F.max(above - spot) * low + F.max(spot - below) * high
        chosen.append(F.when(low.eqNullSafe(high), low).otherwise(between).alias(name))
    known = found.groupBy(*_renamed(keys, "_known")).agg(*chosen)
    everyone = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return everyone.join(known, _same(keys, "_known"), "left").select(*keys, *points)


def _calm_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Running sums ``_sum_<name>`` inside each key."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(c).over(upto).alias(f"_sum_{c}") for c in sums])


def _hot_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str], group_rows: int
) -> DataFrame:
    blocks = _blocks(df, keys, order, group_rows)
    upto, _ = _inside(keys)
    earlier, _ = _scan(keys)
    totals = blocks.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in sums])
    carry = totals.select(
        *keys, "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_carry_{c}") for c in sums]
    )
    inside = blocks.select("*", *[F.sum(c).over(upto).alias(f"_in_{c}") for c in sums])
    kinds = {c: df.select(F.sum(c).alias("s")).schema["s"].dataType for c in sums}
    return _carried(inside, carry, keys).select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_carry_{c}")).cast(kinds[c]).alias(f"_sum_{c}") for c in sums],
    )


def range_sums(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    at: str,
    measures: dict[str, Column],
    high: Column,
    low: Column | None = None,
    open_low: bool = False,
    open_high: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """For each left row, sums over the right rows of its key with ``low <= at <= high``.

    A range join followed by an aggregate, without forming the pairs: the sum over a range is the
    running sum at its end minus the one before its start. Sums start anew for each key. Where a key is
    hot, its right rows of one position are added up before they are ordered. Measures must be exact
    (integers or decimals); others are refused. Nulls in them count as 0. ``open_low`` and ``open_high``
    leave the bound itself out.
    """
    names = list(measures)
    group_rows = _limit(group_rows)
    kinds = right.select(*[m.alias(n) for n, m in measures.items()]).schema
    for field in kinds:
        if not isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
            raise TypeError(f"measure {field.name} is {field.dataType.simpleString()}; sums must be exact")
    # Measures and bounds are columns from here on, whatever expressions they were.
    points = right.dropna(subset=[*keys, at]).select(
        *keys, F.col(at).alias("_at"), *[F.coalesce(m, F.lit(0)).alias(f"_m_{n}") for n, m in measures.items()]
    )
    fits = F.lit(True)
    if low is not None:
        fits = (low < high) if open_low and open_high else (low <= high)
    place = points.schema["_at"].dataType
    nowhere = F.lit(None).cast(place)
    # A missing bound and both ends of an empty range go before all data of the key.
    ranges = left.select(
        *keys,
        *[F.col(c).alias(f"_id_{i}") for i, c in enumerate(left_id)],
        F.when(fits, high).alias("_high"),
        (nowhere if low is None else F.when(fits, low)).alias("_low"),
    )
    points, used = _keyed(points, keys)
    ranges, _ = _keyed(ranges, keys)
    sums = [f"_m_{n}" for n in names]
    kinds = points.select(*[F.sum(c).alias(c) for c in sums]).schema
    ids = [f"_id_{i}" for i in range(len(left_id))]

    def merged(points: DataFrame, ranges: DataFrame) -> DataFrame:
        # _place: before, at or after the data of the same position. _sign: start or end of a range.
        no_id = [F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in ids]
        data = points.select(*used, *no_id, "_at", F.lit(1).alias("_place"), F.lit(0).alias("_sign"), *sums)
        zero = [F.lit(0).cast(points.schema[c].dataType).alias(c) for c in sums]
        probe = lambda bound, spot, sign: ranges.select(
            *used, *ids, F.col(bound).alias("_at"), F.lit(spot).alias("_place"), F.lit(sign).alias("_sign"), *zero
        )
        return data.unionByName(probe("_high", 0 if open_high else 2, 1)).unionByName(
            probe("_low", 2 if open_low else 0, -1)
        )

    order = ["_at", "_place", "_sign", *ids]
    # Each left row adds a start and an end to its key.
    (calm_points, calm_ranges, _), (hot_points, hot_ranges, _) = _apart(used, group_rows, points, ranges, ranges)
    hot_points = hot_points.groupBy(*used, "_at").agg(*[F.sum(c).cast(kinds[c].dataType).alias(c) for c in sums])

    def ends(rows: DataFrame) -> DataFrame:
        # Grouped by key as well: rows that a window has brought together by key need no other shuffle.
        total = [
            F.sum(F.when(F.col("_sign") > 0, F.col(f"_sum_{c}")).otherwise(-F.col(f"_sum_{c}")))
            .cast(kinds[c].dataType)
            .alias(n)
            for n, c in zip(names, sums)
        ]
        done = rows.where(F.col("_sign") != 0).groupBy(*used, *ids).agg(*total)
        return done.select(*[F.col(i).alias(c) for i, c in zip(ids, left_id)], *names)

    return ends(_calm_totals(merged(calm_points, calm_ranges), used, order, sums)).unionAll(
        ends(_hot_totals(merged(hot_points, hot_ranges), used, order, sums, group_rows))
    )


def _cover(low: Column, high: Column) -> Column:
    """Dyadic slots that make up the cells from ``low`` to ``high``, both left out.

    At each level at most one slot at either end is taken, so there are at most twice as many as levels.
    """
    first, past = low + 1, high
    levels = F.sequence(F.lit(0), F.ceil(F.log2((past - first).cast("double") + 1)).cast("int"))

    def ends(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        x, y = -F.floor(-first / width), F.floor(past / width)
        slot = lambda odd, at: F.when((x < y) & (F.pmod(odd, F.lit(2)) == 1), F.struct(level.alias("level"), at.alias("slot")))
        return F.array(slot(x, x), slot(y, y - 1))

    taken = F.filter(F.flatten(F.transform(levels, ends)), lambda s: s.isNotNull())
    return F.when(past > first, taken)


def wide_range_sums(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    at: str,
    measures: dict[str, Column],
    low: Column,
    high: Column,
    cell: float,
    levels: int = 40,
    open_low: bool = False,
    open_high: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """``range_sums`` over numbers for ranges of any width, few keys or none.

    Positions are cut into cells of width ``cell``. Right rows are added up per cell, and cells per
    dyadic slot of each level. The cells inside a range are made up of slots, at most two of a level;
    only rows in its two end cells are compared one by one. So neither a narrow nor a wide range brings
    the rows of one place into one task. A cell about as wide as the narrowest range is a good one.
    Ranges of more than 2^``levels`` cells are refused. Missing bounds and empty ranges have no rows.
    """
    names, ids = list(measures), [f"_id_{i}" for i in range(len(left_id))]
    number = lambda c: F.floor(c / F.lit(cell)).cast("long")
    fits = ((low < high) if open_low and open_high else (low <= high)) & ~F.isnan(low.cast("double")) & ~F.isnan(high.cast("double"))
    ranges = left.select(
        *keys,
        *[F.col(c).alias(i) for c, i in zip(left_id, ids)],
        F.when(fits, low).alias("_low"),
        F.when(fits, high).alias("_high"),
    )
    points = right.dropna(subset=[*keys, at]).select(
        *keys, F.col(at).alias("_at"), number(F.col(at)).alias("_cell"),
        *[F.coalesce(m, F.lit(0)).alias(n) for n, m in measures.items()],
    )
    own = F.array_distinct(F.array(number(F.col("_low")), number(F.col("_high"))))
    at_ends = range_sums(
        ranges.withColumn("_cell", F.explode_outer(own)), points, [*keys, "_cell"], ids, "_at",
        {n: F.col(n) for n in names}, F.col("_high"), F.col("_low"), open_low, open_high, group_rows,
    )
    total = lambda df, by: df.groupBy(*by).agg(*[F.sum(n).alias(n) for n in names])
    kinds = total(points, keys).schema
    slot = lambda level: F.struct(
        level.alias("level"), F.call_function("shiftright", F.col("_cell"), level).alias("slot")
    )
    every = F.transform(F.sequence(F.lit(0), F.lit(levels)), slot)
    slots = total(
        total(points, [*keys, "_cell"]).select(*keys, F.explode(every).alias("_slot"), *names), [*keys, "_slot"]
    )
    cover = _cover(number(F.col("_low")), number(F.col("_high")))
    too_wide = F.exists(cover, lambda s: s["level"] > levels)
    checked = F.when(too_wide, F.raise_error(F.lit("a range has too many cells"))).otherwise(cover)
    # Spark takes an exploded table to be as large as its files, and would send it to all tasks through the
    # driver: some thirty rows for each range, forty for each cell. Either side is shuffled.
    inner = ranges.select(*keys, *ids, F.explode(checked).alias("_slot")).hint("merge").join(slots, [*keys, "_slot"])
    both = total(at_ends.unionByName(inner.select(*ids, *names)), ids)
    return both.select(
        *[F.col(i).alias(c) for i, c in zip(ids, left_id)], *[F.col(n).cast(kinds[n].dataType).alias(n) for n in names]
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    left_at: str,
    right_at: str,
    take: Sequence[str],
    group_rows: int | None = None,
) -> DataFrame:
    """Left rows with the columns ``take`` of the newest right row at or before them, else nulls.

    Among right rows of one key and time the largest values win. Both sides are merged into one
    order, in which a left row takes over the last right row that was seen.
    """
    names = [f"_right_{c}" for c in take]
    values = F.struct(F.col(right_at).alias("_at"), *[F.col(c).alias(n) for c, n in zip(take, names)])
    group_rows = _limit(group_rows)
    seen = right.dropna(subset=[*keys, right_at]).select(
        *keys, F.col(right_at).alias("_at"), values.alias("_seen")
    )
    asked = left.select(
        *keys,
        F.col(left_at).alias("_at"),
        *[F.col(c).alias(f"_id_{i}") for i, c in enumerate(left_id)],
        F.struct(*[F.col(c) for c in left.columns]).alias("_own"),
    )
    seen, used = _keyed(seen, keys)
    asked, _ = _keyed(asked, keys)
    ids = [f"_id_{i}" for i in range(len(left_id))]
    order = ["_at", "_side", "_seen", *ids]

    def merged(seen: DataFrame, asked: DataFrame) -> DataFrame:
        nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
        return seen.select(
            *used, "_at", F.lit(0).alias("_side"), *[nothing(asked, c) for c in ids], "_seen", nothing(asked, "_own")
        ).unionByName(asked.select(*used, "_at", F.lit(1).alias("_side"), *ids, nothing(seen, "_seen"), "_own"))

    (calm_seen, calm_asked), (hot_seen, hot_asked) = _apart(used, group_rows, seen, asked)
    hot_seen = hot_seen.groupBy(*used, "_at").agg(F.max("_seen").alias("_seen"))
    window = Window.partitionBy(*used).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calm = merged(calm_seen, calm_asked).withColumn("_hit", F.last("_seen", ignorenulls=True).over(upto))
    hot = _last_seen(_blocks(merged(hot_seen, hot_asked), used, order, group_rows), used)
    found = lambda rows: rows.where("_side = 1").select(
        "_own.*", *[F.col(f"_hit.{n}").alias(c) for c, n in zip(take, names)]
    )
    return found(calm).unionAll(found(hot))


def _last_seen(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last ``_seen`` of the key at or before each row, across blocks."""
    upto, _ = _inside(keys)
    earlier, _ = _scan(keys)
    known = F.col("_seen").isNotNull()
    latest = blocks.groupBy(*keys, "_block").agg(F.max_by("_seen", F.when(known, F.col("_pos"))).alias("m"))
    carry = latest.select(*keys, "_block", F.last("m", ignorenulls=True).over(earlier).alias("_carry"))
    inside = blocks.withColumn("_in", F.last("_seen", ignorenulls=True).over(upto))
    return _carried(inside, carry, keys).withColumn("_hit", F.coalesce("_in", "_carry"))


def sessions(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    gap_seconds: int,
    measures: dict[str, Column],
    group_rows: int | None = None,
) -> DataFrame:
    """Sessions per key: runs of rows whose neighbours are at most the gap apart.

    Rows inside one slice of gap length belong together whatever else there is, so slices are added
    up first, map-side; only one row per key and slice is ordered. Measures are sums.
    """
    if isinstance(df.schema[at].dataType, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    else:
        micros = F.unix_micros(at)
    slice_no = F.floor(micros / F.lit(gap_seconds * 1_000_000))
    df, used = _keyed(df, keys)
    slices = (
        df.dropna(subset=[at])
        .groupBy(*used, slice_no.alias("_slice"))
        .agg(F.min(at).alias("_from"), F.max(at).alias("_to"), *[F.sum(m).alias(n) for n, m in measures.items()])
    )
    group_rows = _limit(group_rows)
    (calm,), (hot,) = _apart(used, group_rows, slices)
    before = {"_prev": look_back("_to")}
    apart = F.coalesce(F.col("_from") > F.col("_prev") + F.make_dt_interval(secs=F.lit(gap_seconds)), F.lit(True))
    fresh = lambda rows: rows.withColumn("_new", apart.cast("long"))
    order = ["_slice"]
    plain = _calm_totals(fresh(_calm_neighbours(calm, used, order, before)), used, order, ["_new"])
    linked = fresh(_hot_neighbours(hot, used, order, before, group_rows))
    numbered = plain.unionAll(_hot_totals(linked, used, order, ["_new"], group_rows))
    return (
        numbered.groupBy(*used, "_sum__new")
        .agg(F.min("_from").alias("start"), F.max("_to").alias("last"), *[F.sum(n).alias(n) for n in measures])
        .select(*keys, "start", "last", *measures)
    )
