"""Column profiles that add up: counts, bounds and sketches per file, partition or day.

``column_sketches`` reads the rows once and gives one row for each group. Such rows are stored, and
``merged_sketches`` makes those of any union out of them without the data. Counts and bounds of a merge
are exact; distinct counts come from HyperLogLog sketches and quantiles from KLL sketches, whose errors do
not grow with merging.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.values import binary_text
from gridlark.operators.inspect import UNORDERED, is_float, schema_leaves

# Sizes of the sketches, and the errors that they keep but for about one time in a million: of a
# distinct count relative to it (five times 1.04 / sqrt(2^LG_K)), and of a quantile's rank.
LG_K, K = 12, 400
DISTINCT_ERROR = 5 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 0.02


def _kinds(schema: T.StructType) -> Iterator[tuple[int, str, T.StructField, Column]]:
    for i, (path, field, col) in enumerate(schema_leaves(schema)):
        yield i, path, field, col


def _is_ordered(dtype: T.DataType) -> bool:
    return not isinstance(dtype, UNORDERED)


def _is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _countable(col: Column, dtype: T.DataType) -> Column:
    """A value as a type that distinct values can be counted of."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
        return col
    return col.cast("long") if isinstance(dtype, (T.ByteType, T.ShortType)) else col.cast("string")


def column_sketches(df: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """One row per group: ``rows``, and for the i-th field ``null_i``, ``nan_i``, ``low_i``, ``high_i``,
    ``distinct_i`` and, for numbers, ``ranks_i``.

    Groups are columns or expressions, such as ``F.col("_metadata.file_path").alias("file")``. NaN is no
    bound, has no rank and is one distinct value.
    """
    totals = [F.count(F.lit(1)).alias("rows")]
    for i, _, field, col in _kinds(df.schema):
        dtype = field.dataType
        totals.append(F.count_if(col.isNull()).alias(f"null_{i}"))
        known = col
        if is_float(dtype):
            totals.append(F.count_if(F.isnan(col)).alias(f"nan_{i}"))
            known = F.when(~F.isnan(col), col)
        if _is_ordered(dtype):
            totals += [
                F.min(known).alias(f"low_{i}"),
                F.max(known).alias(f"high_{i}"),
                F.hll_sketch_agg(_countable(col, dtype), F.lit(LG_K)).alias(f"distinct_{i}"),
            ]
        if _is_numeric(dtype):
            totals.append(F.kll_sketch_agg_double(known.cast("double"), F.lit(K)).alias(f"ranks_{i}"))
    return df.groupBy(*by).agg(*totals)


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the union of all groups, or of those alike in ``by``."""
    merge = {
        "rows": F.sum, "null": F.sum, "nan": F.sum, "low": F.min, "high": F.max,
        "distinct": lambda c: F.hll_union_agg(c, F.lit(True)), "ranks": lambda c: F.kll_merge_agg_double(c),
    }
    totals = []
    for name in sketches.columns:
        kind, _, number = name.partition("_")
        if kind in merge and (number.isdigit() or name == "rows"):
            totals.append(merge[kind](F.col(name)).alias(name))
    return sketches.groupBy(*by).agg(*totals)


def sketched_profile(sketches: DataFrame, schema: T.StructType, points: Sequence[float] = (0.5,)) -> DataFrame:
    """One row per field and group: path, type, counts and bounds as in ``column_profile``, and the
    estimates ``distinct_count`` and ``quantiles`` (one for each of ``points``; null where there are no
    numbers)."""
    made = set(sketches.columns)
    own = [c for c in sketches.columns if c != "rows" and not c.partition("_")[2].isdigit()]
    lines = []
    for i, path, field, _ in _kinds(schema):
        dtype = field.dataType
        col = lambda kind: F.col(f"{kind}_{i}") if f"{kind}_{i}" in made else None  # noqa: E731, B023
        text = lambda c: binary_text(c) if isinstance(dtype, T.BinaryType) else c.cast("string")  # noqa: E731, B023
        nothing = F.lit(None).cast("string")
        quantiles = F.lit(None).cast("array<double>")
        if _is_numeric(dtype):
            some = F.kll_sketch_get_n_double(col("ranks")) > 0
            quantiles = F.when(some, F.array(*[F.kll_sketch_get_quantile_double(col("ranks"), F.lit(p)) for p in points]))
        lines.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(path).alias("path"),
                F.lit(dtype.simpleString()).alias("type"),
                F.col("rows").alias("value_count"),
                col("null").alias("null_count"),
                (F.lit(None).cast("bigint") if col("nan") is None else col("nan")).alias("nan_count"),
                (nothing if col("low") is None else text(col("low"))).alias("lower"),
                (nothing if col("high") is None else text(col("high"))).alias("upper"),
                (F.lit(None).cast("bigint") if col("distinct") is None else F.hll_sketch_estimate(col("distinct"))).alias("distinct_count"),
                quantiles.alias("quantiles"),
            )
        )
    return sketches.select(*own, F.inline(F.array(*lines)))
