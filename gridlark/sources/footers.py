"""Parquet files of a table: listing and footers."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from decimal import Decimal
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

# What a footer adds to a listed file. Keys of the maps are paths of leaf columns; bounds are raw texts,
# see ``_raw``.
STATISTICS = (
    "record_count BIGINT, column_sizes MAP<STRING, BIGINT>, value_counts MAP<STRING, BIGINT>, "
    "null_counts MAP<STRING, BIGINT>, lower MAP<STRING, STRING>, upper MAP<STRING, STRING>, "
    "split_offsets ARRAY<BIGINT>"
)
LISTED = "file_path STRING, file_size_in_bytes BIGINT, last_modified TIMESTAMP"


def same_path(path: Column) -> Column:
    """One spelling of a file path: ``file:///x`` and ``file:/x`` are the same file."""
    return F.regexp_replace(path, r"^file:/+", "file:/")


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """Path, size and time of the files below ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            same_path(F.col("path")).alias("file_path"),
            F.col("length").alias("file_size_in_bytes"),
            F.col("modificationTime").alias("last_modified"),
        )
    )


def _raw(value: object) -> str | None:
    """A bound as text that Spark can turn into the column's type; ``None`` for NaN.

    Times are microseconds since 1970, binary values base64.
    """
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime):
        zone = value.tzinfo or timezone.utc
        return str((value.replace(tzinfo=zone) - EPOCH) // timedelta(microseconds=1))
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return str(value)


@dataclass
class _Leaf:
    """One leaf column over the row groups of a file; ``None`` is what some row group does not tell."""

    size: int = 0
    values: int = 0
    nulls: int | None = 0
    low: object = None
    high: object = None
    bounded: bool = True

    def add(self, chunk: pq.ColumnChunkMetaData) -> None:
        self.size += chunk.total_compressed_size
        self.values += chunk.num_values
        told = chunk.statistics
        nulls = told.null_count if told is not None and told.has_null_count else None
        self.nulls = None if nulls is None or self.nulls is None else self.nulls + nulls
        if nulls == chunk.num_values:
            return
        low, high = (told.min, told.max) if told is not None and told.has_min_max else (None, None)
        if low is None or high is None or low != low or high != high:
            self.bounded = False
        elif self.bounded:
            self.low = low if self.low is None else min(self.low, low)
            self.high = high if self.high is None else max(self.high, high)


def _footer(path: str) -> dict:
    """Row groups of one file, read from its footer alone."""
    # from_uri decodes, and a listed path is not encoded.
    uri = quote(path.replace("file:/", "file:///", 1), safe=":/@")
    system, local = fs.FileSystem.from_uri(uri)
    leaves: dict[str, _Leaf] = {}
    offsets = []
    with system.open_input_file(local) as source:
        meta = pq.ParquetFile(source).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            chunks = [group.column(c) for c in range(group.num_columns)]
            for chunk in chunks:
                leaves.setdefault(chunk.path_in_schema, _Leaf()).add(chunk)
            offsets.append(min(c.dictionary_page_offset or c.data_page_offset for c in chunks))
    bounded = {name: leaf for name, leaf in leaves.items() if leaf.bounded and leaf.low is not None}
    return {
        "record_count": meta.num_rows,
        "column_sizes": [(name, leaf.size) for name, leaf in leaves.items()],
        "value_counts": [(name, leaf.values) for name, leaf in leaves.items()],
        "null_counts": [(name, leaf.nulls) for name, leaf in leaves.items() if leaf.nulls is not None],
        "lower": [(name, _raw(leaf.low)) for name, leaf in bounded.items()],
        "upper": [(name, _raw(leaf.high)) for name, leaf in bounded.items()],
        "split_offsets": offsets,
    }


def _read_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, texts = pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.string())
    told = pa.schema(
        [
            ("record_count", pa.int64()),
            ("column_sizes", counts),
            ("value_counts", counts),
            ("null_counts", counts),
            ("lower", texts),
            ("upper", texts),
            ("split_offsets", pa.list_(pa.int64())),
        ]
    )
    for batch in batches:
        rows = pa.RecordBatch.from_pylist([_footer(path) for path in batch.column(0).to_pylist()], schema=told)
        yield pa.RecordBatch.from_arrays([*batch.columns, *rows.columns], [*batch.schema.names, *told.names])


def read_footers(listing: DataFrame) -> DataFrame:
    """The listed Parquet files with what their footers tell, at the cost of one footer each.

    Bounds are those of all row groups together; a column is left out of a map where some row group
    does not tell, as for columns with NaN or old-style timestamps. Footers hold no counts of NaN.
    """
    columns = [c.split()[0] for c in LISTED.split(", ")]
    return listing.select(*columns).repartition("file_path").mapInArrow(_read_footers, f"{LISTED}, {STATISTICS}")


def file_footers(spark: SparkSession, path: str) -> DataFrame:
    """Footers of all Parquet files below ``path``."""
    return read_footers(list_files(spark, path))
