"""Looking into one table: columns, snapshots, files, partitions, headline numbers."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlark.functions.values import binary_text, quoted, unsafe_integer
from gridlark.sources.footers import read_footers, same_path

log = logging.getLogger(__name__)

# Rows of a metadata listing, bytes of a megabyte, text for what is not known.
LISTED_ROWS = 250
MEGABYTE = 1024.0 * 1024.0
UNKNOWN = "N/A"

# Columns of the file list, in order.
FILE_COLUMNS = (
    "content file_path file_format spec_id partition record_count file_size_mb column_sizes value_counts "
    "null_value_counts nan_value_counts lower_bounds upper_bounds key_metadata split_offsets equality_ids "
    "sort_order_id"
).split()

# Fixed value: how a partition folder spells null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"

UNORDERED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.CalendarIntervalType)


# Columns -------------------------------------------------------------------------------------


def schema_leaves(schema: T.StructType, parent: Column | None = None, prefix: str = "") -> Iterator[tuple]:
    """Every field, nested ones after their parent: path, field, expression."""
    for field in schema.fields:
        col = F.col(quoted(field.name)) if parent is None else parent.getField(field.name)
        path = prefix + field.name
        yield path, field, col
        if isinstance(field.dataType, T.StructType):
            yield from schema_leaves(field.dataType, col, path + ".")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def _nans(col: Column, dtype: T.DataType) -> Column:
    return F.count_if(F.isnan(col)) if is_float(dtype) else F.lit(None).cast("bigint")


def _bound(col: Column, dtype: T.DataType, pick) -> Column:
    """Lowest or highest value as text. NaN is no bound."""
    if isinstance(dtype, UNORDERED):
        return F.lit(None).cast("string")
    if is_float(dtype):
        col = F.when(~F.isnan(col), col)
    found = pick(col)
    return binary_text(found) if isinstance(dtype, T.BinaryType) else found.cast("string")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per field: path, type, nullable, values, nulls, NaNs, lowest and highest value.

    All fields share one scan and one aggregation. ``value_count`` counts nulls and NaNs too.
    """
    fields = list(schema_leaves(df.schema))
    totals = [F.count(F.lit(1)).alias("rows")]
    for i, (_, field, col) in enumerate(fields):
        totals += [
            F.count_if(col.isNull()).alias(f"null_{i}"),
            _nans(col, field.dataType).alias(f"nan_{i}"),
            _bound(col, field.dataType, F.min).alias(f"low_{i}"),
            _bound(col, field.dataType, F.max).alias(f"high_{i}"),
        ]
    lines = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(path).alias("path"),
            F.lit(field.dataType.simpleString()).alias("type"),
            F.lit(field.nullable).alias("nullable"),
            F.col("rows").alias("value_count"),
            F.col(f"null_{i}").alias("null_count"),
            F.col(f"nan_{i}").alias("nan_count"),
            F.col(f"low_{i}").alias("lower"),
            F.col(f"high_{i}").alias("upper"),
        )
        for i, (path, field, _) in enumerate(fields)
    ]
    return df.agg(*totals).select(F.inline(F.array(*lines)))


def grid_columns(df: DataFrame, order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Column headings from the first row alone: position, name, and a basic type.

    Null and nested values are ``object``; integers beyond the client's range arrive as text. No
    rows, no columns.
    """

    def basic(col: Column, dtype: T.DataType) -> Column:
        if isinstance(dtype, UNORDERED):
            kind = F.lit("object")
        elif isinstance(dtype, T.BooleanType):
            kind = F.lit("boolean")
        elif isinstance(dtype, T.IntegralType):
            kind = F.when(unsafe_integer(col), "string").otherwise("number")
        elif isinstance(dtype, T.NumericType):
            kind = F.lit("number")
        else:
            kind = F.lit("string")
        return F.when(col.isNull(), "object").otherwise(kind)

    headings = [
        F.struct(
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("name"),
            basic(F.col(quoted(f.name)), f.dataType).alias("type"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    first = (df.orderBy(*order_by) if order_by else df).limit(1)
    return first.select(F.inline(F.array(*headings)))


# Snapshots -----------------------------------------------------------------------------------


# Grains and the span of time whose commits one task orders: at most some million of them.
SPANS = {
    "microsecond": "second", "millisecond": "hour", "second": "month", "minute": "year", "hour": "year",
}


def snapshot_log(df: DataFrame, at: str, grain: str = "day") -> DataFrame:
    """A commit log from the times of rows: one snapshot per day (or other grain) that has rows.

    Rows are counted per commit first. At grains below a day running totals and parents are taken per
    span of time and carried from span to span, so that one task orders one row per span; days and
    longer ones are so few that one task orders them all.
    """
    start = F.date_trunc(grain, F.col(at))
    commits = df.where(F.col(at).isNotNull()).groupBy(start.alias("_start")).agg(
        F.count(F.lit(1)).alias("added"), F.max(at).alias("committed_at")
    )
    # Seconds of the wall clock, so the id does not depend on the session's zone; finer grains count
    # their own units.
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    unit = grain.upper() if grain in ("microsecond", "millisecond") else "SECOND"
    number = F.timestamp_diff(unit, epoch, F.col("_start").cast("timestamp_ntz"))
    span = F.date_trunc(SPANS[grain], F.col("_start")) if grain in SPANS else F.lit(0)
    commits = commits.withColumns({"_number": number, "_span": span})
    if grain in SPANS:
        spans = commits.groupBy("_span").agg(F.sum("added").alias("_all"), F.max("_number").alias("_last"))
        earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
        carry = spans.select(
            F.col("_span").alias("_of"),
            F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"),
            F.max("_last").over(earlier).alias("_previous"),
        )
        commits = commits.join(carry, F.col("_span") == F.col("_of"))
    else:
        commits = commits.withColumns({"_before": F.lit(0), "_previous": F.lit(None).cast("long")})
    in_order = Window.partitionBy("_span").orderBy("_start")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summary = F.create_map(
        F.lit("added-records"),
        F.col("added").cast("string"),
        F.lit("total-records"),
        (F.col("_before") + F.sum("added").over(upto)).cast("string"),
    )
    return commits.select(
        "committed_at",
        F.col("_number").alias("snapshot_id"),
        F.coalesce(F.lag("_number").over(in_order), F.col("_previous")).alias("parent_id"),
        F.lit("append").alias("operation"),
        summary.alias("summary"),
    )


def snapshots(log: DataFrame, n: int = LISTED_ROWS) -> DataFrame:
    """The newest ``n`` snapshots, newest first."""
    return log.orderBy(F.desc("committed_at"), F.desc("snapshot_id")).limit(n)


# Files and partitions ------------------------------------------------------------------------


def _decoded(raw: Column) -> Column:
    """A file path without URL encoding. A plus sign in it is no space."""
    return same_path(F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def file_inventory(
    df: DataFrame, partition_by: Sequence[str] = (), listing: DataFrame | None = None
) -> DataFrame:
    """One row per data file of a file-based table, computed from its rows in one scan.

    ``listing`` (path, size, time) adds files that hold no rows. A view has no files: the result is
    an error there, as the hidden metadata columns do not exist.
    """
    columns = [f for f in df.schema.fields if f.name not in partition_by]
    per_column = {
        "value_counts": lambda c, t: F.count(F.lit(1)),
        "null_value_counts": lambda c, t: F.count_if(c.isNull()),
        "nan_value_counts": lambda c, t: _nans(c, t),
        "lower_bounds": lambda c, t: _bound(c, t, F.min),
        "upper_bounds": lambda c, t: _bound(c, t, F.max),
    }
    totals = [
        F.count(F.lit(1)).alias("record_count"),
        # A set of one size per file. Having a set among the aggregates makes Spark hash the few
        # files of a task instead of sorting all its rows, as text bounds alone would.
        F.collect_set("_metadata.file_size")[0].alias("file_size_in_bytes"),
        F.max("_metadata.file_modification_time").alias("last_modified"),
        # Every row of a file has the same partition values.
        *[F.max(quoted(c)).alias(f"part_{i}") for i, c in enumerate(partition_by)],
    ]
    for kind, make in per_column.items():
        for i, f in enumerate(columns):
            totals.append(make(F.col(quoted(f.name)), f.dataType).alias(f"{kind}_{i}"))
    # Grouped by the path as it comes; it is decoded once per file, not once per row.
    per_file = df.groupBy(F.col("_metadata.file_path").alias("raw_path")).agg(*totals)

    def as_map(kind: str) -> Column:
        pairs = [
            F.struct(F.lit(f.name).alias("key"), F.col(f"{kind}_{i}").alias("value"))
            for i, f in enumerate(columns)
        ]
        known = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
        return F.map_from_entries(known).alias(kind)

    parts = [F.col(f"part_{i}").alias(c) for i, c in enumerate(partition_by)]
    files = per_file.select(
        _decoded(F.col("raw_path")).alias("file_path"),
        "record_count",
        "file_size_in_bytes",
        "last_modified",
        *([F.struct(*parts).alias("partition")] if parts else []),
        *[as_map(kind) for kind in per_column],
    )
    if listing is None:
        return files
    both = listing.alias("l").join(files.alias("f"), "file_path", "left")
    return both.select(
        "file_path",
        F.coalesce("f.record_count", F.lit(0)).alias("record_count"),
        F.coalesce("l.file_size_in_bytes", "f.file_size_in_bytes").alias("file_size_in_bytes"),
        F.coalesce("l.last_modified", "f.last_modified").alias("last_modified"),
        *[f"f.{c}" for c in files.columns[4:]],
    )


def _footer_leaves(dtype: T.DataType, path: str) -> Iterator[tuple[str, T.DataType]]:
    """Leaf columns as Parquet names them, with their types."""
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            yield from _footer_leaves(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(dtype, T.ArrayType):
        yield from _footer_leaves(dtype.elementType, f"{path}.list.element")
    elif isinstance(dtype, T.MapType):
        yield from _footer_leaves(dtype.keyType, f"{path}.key_value.key")
        yield from _footer_leaves(dtype.valueType, f"{path}.key_value.value")
    elif not isinstance(dtype, UNORDERED):
        yield path, dtype


def _bound_text(raw: Column, dtype: T.DataType) -> Column:
    """A footer's bound written as Spark writes a value of the type."""
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(raw.cast("bigint")).cast("string")
    if isinstance(dtype, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_add("MICROSECOND", raw.cast("bigint"), epoch).cast("string")
    if isinstance(dtype, T.BinaryType):
        return binary_text(F.unbase64(raw))
    return raw.try_cast(dtype).cast("string")


def _path_partition(df: DataFrame, partition_by: Sequence[str]) -> Column:
    """The partition's values as the folders of a file's path spell them."""

    def value(name: str) -> Column:
        raw = F.regexp_extract("file_path", rf"/{re.escape(name)}=([^/]*)/", 1)
        known = F.when(raw != NO_VALUE, F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
        return known.try_cast(df.schema[name].dataType).alias(name)

    return F.struct(*map(value, partition_by)).alias("partition")


def path_partitions(df: DataFrame, listing: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """The partition of each listed file, from its path alone."""
    return listing.select(_path_partition(df, partition_by))


def footer_inventory(df: DataFrame, footers: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """One row per Parquet file of ``read_footers``, without reading any rows.

    Partition values come from the paths. Counts and bounds are those of leaf columns, named by their
    path in the file (``event.context.ip``); what the footers do not tell is absent.
    """
    inside = T.StructType([f for f in df.schema.fields if f.name not in partition_by])
    leaves = list(_footer_leaves(inside, ""))

    def bounds(kind: str) -> Column:
        told = lambda path: F.try_element_at(kind, F.lit(path))
        pairs = [
            F.struct(F.lit(path).alias("key"), _bound_text(told(path), dtype).alias("value")) for path, dtype in leaves
        ]
        known = F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())
        return F.map_from_entries(known).alias(f"{kind}_bounds")

    parts = [_path_partition(df, partition_by)] if partition_by else []
    return footers.select(
        "file_path",
        "record_count",
        "file_size_in_bytes",
        "last_modified",
        *parts,
        "column_sizes",
        "value_counts",
        F.col("null_counts").alias("null_value_counts"),
        F.lit(None).cast("map<string,bigint>").alias("nan_value_counts"),
        bounds("lower"),
        bounds("upper"),
        "split_offsets",
    )


def with_nan_counts(inventory: DataFrame, df: DataFrame, paths: Sequence[str] | None = None) -> DataFrame:
    """Add to a footer inventory what only rows tell: NaNs and bounds of top-level float columns.

    Reads those columns alone, and of the files ``paths`` alone, if given (paths as listed).
    """
    floats = [f for f in df.schema.fields if is_float(f.dataType)]
    if not floats:
        return inventory
    path = _decoded(F.col("_metadata.file_path"))
    rows = df if paths is None else df.where(path.isin(list(paths)))
    kinds = {
        "nan_value_counts": lambda c, t: _nans(c, t),
        "lower_bounds": lambda c, t: _bound(c, t, F.min),
        "upper_bounds": lambda c, t: _bound(c, t, F.max),
    }
    totals = [
        make(F.col(quoted(f.name)), f.dataType).alias(f"{kind}_{i}")
        for kind, make in kinds.items()
        for i, f in enumerate(floats)
    ]
    # A set among the aggregates makes Spark hash the few files of a task instead of sorting its rows.
    totals.append(F.collect_set("_metadata.file_size").alias("_sizes"))
    per_file = rows.groupBy(F.col("_metadata.file_path").alias("raw_path")).agg(*totals)

    def as_map(kind: str) -> Column:
        pairs = [
            F.struct(F.lit(f.name).alias("key"), F.col(f"{kind}_{i}").alias("value")) for i, f in enumerate(floats)
        ]
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())).alias(f"_{kind}")

    found = per_file.select(_decoded(F.col("raw_path")).alias("file_path"), *map(as_map, kinds))
    names = F.array(*[F.lit(f.name) for f in floats])

    def merged(kind: str) -> Column:
        rest = F.map_filter(F.coalesce(kind, F.create_map().cast(inventory.schema[kind].dataType)), lambda k, v: ~F.array_contains(names, k))
        return F.when(F.col(f"_{kind}").isNull(), F.col(kind)).otherwise(F.map_concat(rest, f"_{kind}")).alias(kind)

    joined = inventory.join(found, "file_path", "left")
    return joined.select(*[merged(c) if c in kinds else F.col(c) for c in inventory.columns])


def parquet_files(
    df: DataFrame,
    listing: DataFrame,
    partition_by: Sequence[str] = (),
    n: int | None = LISTED_ROWS,
    nan_counts: bool = False,
) -> DataFrame:
    """File list of a Parquet table from its listing, cut to ``n`` before any footer is read.

    No rows are read unless ``nan_counts`` are asked for; those take the float columns of the listed
    files.
    """
    kept = listing if n is None else listing.orderBy("file_path").limit(n)
    inventory = footer_inventory(df, read_footers(kept), partition_by)
    if nan_counts:
        # At most n paths, so that the scan can leave out all other files.
        paths = None if n is None else [r.file_path for r in kept.select("file_path").collect()]
        inventory = with_nan_counts(inventory, df, paths)
    return files(inventory, n=n)


def files(inventory: DataFrame, n: int | None = LISTED_ROWS, file_format: str = "PARQUET") -> DataFrame:
    """File list: what a file holds, its size in MB, and counts and bounds per column.

    ``partition`` is listed only where the table has one. An inventory that a table format keeps
    itself is listed with its own columns.
    """
    absent = {
        "content": F.lit(0),
        "file_format": F.lit(file_format),
        "spec_id": F.lit(0),
        "column_sizes": F.lit(None).cast("map<string,bigint>"),
        "key_metadata": F.lit(None).cast("binary"),
        "split_offsets": F.lit(None).cast("array<bigint>"),
        "equality_ids": F.lit(None).cast("array<int>"),
        "sort_order_id": F.lit(0),
    }
    there = set(inventory.columns)

    def listed_column(name: str) -> Column:
        if name == "file_size_mb":
            return (F.col("file_size_in_bytes") / F.lit(MEGABYTE)).alias(name)
        return F.col(name) if name in there else absent[name].alias(name)

    listed = inventory.select(*[listed_column(c) for c in FILE_COLUMNS if c != "partition" or c in there])
    return listed if n is None else listed.orderBy("file_path").limit(n)


def partitions(inventory: DataFrame, n: int | None = LISTED_ROWS) -> DataFrame:
    """Partition list from a file inventory: value, rows, files, bytes, last change."""
    found = inventory.groupBy("partition").agg(
        F.sum("record_count").alias("record_count"),
        F.count(F.lit(1)).alias("file_count"),
        F.sum("file_size_in_bytes").alias("total_size_bytes"),
        F.max("last_modified").alias("last_updated_at"),
    )
    return found if n is None else found.orderBy("partition").limit(n)


def flatten_partition(parts: DataFrame) -> DataFrame:
    """The partition's fields as top-level columns.

    On a name clash the partition's field takes the other's place; rows without a partition keep
    their own value.
    """
    if "partition" not in parts.columns or not isinstance(parts.schema["partition"].dataType, T.StructType):
        return parts
    inner = parts.schema["partition"].dataType.fieldNames()
    outer = [c for c in parts.columns if c != "partition"]
    kept = [
        F.when(F.col("partition").isNotNull(), F.col("partition").getField(c))
        .otherwise(F.col(quoted(c)))
        .alias(c)
        if c in inner
        else F.col(quoted(c))
        for c in outer
    ]
    return parts.select(*kept, *[F.col("partition").getField(c).alias(c) for c in inner if c not in outer])


# Headline numbers ----------------------------------------------------------------------------


def _time_text(at: Column) -> Column:
    """Date and time; six digits of a second only where there are any."""
    whole = F.date_trunc("second", at) == at
    return F.when(whole, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


def _with_commas(n: Column) -> Column:
    return F.format_number(n.cast("decimal(38,0)"), 0)


def _partition_columns(df: DataFrame) -> Column:
    """Names of the partition columns, given at least one row; null where there are none."""
    names = ""
    if "partition" in df.columns and isinstance(df.schema["partition"].dataType, T.StructType):
        names = ", ".join(df.schema["partition"].dataType.fieldNames())
    return F.when((F.count(F.lit(1)) > 0) & F.lit(bool(names)), F.lit(names)).alias("partition_columns")


def _metric_parts(
    snapshot_rows: DataFrame | None,
    file_rows: DataFrame | None,
    partition_rows: DataFrame | None,
    df: DataFrame | None,
) -> list[DataFrame]:
    """One aggregate of one row for each source that is given."""
    given = [d for d in (snapshot_rows, file_rows, partition_rows, df) if d is not None]
    if not given:
        raise ValueError("metrics need at least one source")
    parts = []
    if df is not None:
        one = given[0].sparkSession.range(1)
        parts.append(one.select(F.lit(str(len(df.schema.fields))).alias("column_count")))
    if snapshot_rows is not None:
        newest = F.max_by(
            F.try_element_at("summary", F.lit("total-records")), F.struct("committed_at", "snapshot_id")
        )
        parts.append(
            snapshot_rows.agg(
                _time_text(F.max("committed_at").cast("timestamp")).alias("last_snapshot"),
                _time_text(F.min("committed_at").cast("timestamp")).alias("earliest_snapshot"),
                _with_commas(newest.try_cast("bigint")).alias("snapshot_rows"),
            )
        )
    if file_rows is not None:
        mean = F.sum("file_size_in_bytes") / F.lit(MEGABYTE) / F.count(F.lit(1))
        from_files = [_partition_columns(file_rows)] if partition_rows is None else []
        parts.append(
            file_rows.agg(
                *from_files,
                _with_commas(F.sum("record_count")).alias("file_rows"),
                F.concat(F.replace(F.format_number(mean, 2), F.lit(","), F.lit("")), F.lit(" MB")).alias(
                    "avg_file_size"
                ),
            )
        )
    if partition_rows is not None:
        # One row tells whether there is a partition at all.
        parts.append(partition_rows.limit(1).agg(_partition_columns(partition_rows)))
    return parts


# The six numbers and where they come from, first choice first.
METRICS = {
    "last_snapshot": ("last_snapshot",),
    "earliest_snapshot": ("earliest_snapshot",),
    "row_count": ("snapshot_rows", "file_rows"),
    "column_count": ("column_count",),
    "avg_file_size": ("avg_file_size",),
    "partition_columns": ("partition_columns",),
}


def table_metrics(
    snapshot_rows: DataFrame | None = None,
    file_rows: DataFrame | None = None,
    partition_rows: DataFrame | None = None,
    df: DataFrame | None = None,
) -> DataFrame:
    """Six numbers in one row; each source may be missing and gives ``N/A`` then.

    The row count is the newest snapshot's ``total-records``, else the sum over files. Without a
    partition list the partition columns come from the files. Every source is one aggregate; their
    one-row results are stacked and merged in one job, so a source that fails fails the row. See
    ``guarded_metrics``.
    """
    merged, *rest = _metric_parts(snapshot_rows, file_rows, partition_rows, df)
    for part in rest:
        merged = merged.unionByName(part, allowMissingColumns=True)

    def known(columns: Sequence[str]) -> Column:
        there = [F.max(c) for c in columns if c in merged.columns]
        return F.coalesce(*there, F.lit(UNKNOWN))

    return merged.agg(*[known(columns).alias(name) for name, columns in METRICS.items()])


def guarded_metrics(
    snapshot_rows: DataFrame | None = None,
    file_rows: DataFrame | None = None,
    partition_rows: DataFrame | None = None,
    df: DataFrame | None = None,
) -> DataFrame:
    """The numbers of ``table_metrics``, each source in a job of its own, run at once.

    A source that fails while it runs, a broken footer for one, leaves ``N/A`` in its own fields and
    all others as they are. Each job gives one row to the driver.
    """
    found: dict[str, str] = {}
    parts = _metric_parts(snapshot_rows, file_rows, partition_rows, df)
    for part in parts:
        try:
            found.update(part.first().asDict())
        except Exception as e:
            log.warning("no %s: %s", ", ".join(part.columns), str(e).splitlines()[0])

    def known(columns: Sequence[str]) -> Column:
        there = [found[c] for c in columns if found.get(c) is not None]
        return F.lit(there[0] if there else UNKNOWN)

    one = parts[0].sparkSession.range(1)
    return one.select(*[known(columns).alias(name) for name, columns in METRICS.items()])
