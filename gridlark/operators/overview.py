"""Everything about one table, by its name."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.text import checked_name
from gridlark.operators.inspect import (
    LISTED_ROWS,
    column_profile,
    file_inventory,
    files,
    footer_inventory,
    guarded_metrics,
    parquet_files,
    partitions,
    path_partitions,
    snapshots,
)
from gridlark.sources.footers import list_files, read_footers

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Overview:
    """Schema and definition, and the metadata that the table has; ``None`` where it has none."""

    schema: dict
    ddl: str
    properties: DataFrame | None
    profile: DataFrame
    snapshots: DataFrame | None
    partitions: DataFrame | None
    files: DataFrame | None
    measured: dict[str, DataFrame | None]

    @cached_property
    def metrics(self) -> DataFrame:
        """The headline numbers. They are taken when first asked for, each source alone."""
        return guarded_metrics(**self.measured)


def metadata_table(spark: SparkSession, name: str, kind: str) -> DataFrame | None:
    """``<table>.snapshots``, ``.files`` or ``.partitions`` where the table's format keeps them."""
    try:
        return spark.table(f"{name}.{kind}")
    except Exception as e:
        log.debug("no %s of %s: %s", kind, name, e)
        return None


def _storage(spark: SparkSession, name: str) -> tuple[str | None, bool]:
    """Folder of a table that is made of files, ``None`` for a view; and whether they are Parquet."""
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {name}")
    found = details.where(F.col("col_name").isin("Location", "Type", "Provider")).select("col_name", "data_type")
    known = {row.col_name: row.data_type for row in found.collect()}
    folder = None if known.get("Type") == "VIEW" else known.get("Location")
    return folder, (known.get("Provider") or "").lower() == "parquet"


@dataclass(frozen=True)
class _Sources:
    """Frames that describe a table's files: for the list, the partitions, and the numbers."""

    listed: DataFrame | None = None
    partitions: DataFrame | None = None
    rows: DataFrame | None = None
    places: DataFrame | None = None


def _file_sources(spark: SparkSession, name: str, df: DataFrame) -> _Sources:
    """Where the files are Parquet, listing, footers and paths have all of it; no rows are read."""
    kept = metadata_table(spark, name, "files")
    if kept is not None:
        return _Sources(files(kept), rows=kept)
    try:
        folder, footed = _storage(spark, name)
        if folder is None:
            return _Sources()
        parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
        listing = list_files(spark, folder)
        if not footed:
            full = file_inventory(df, parts, listing)
            return _Sources(files(full), partitions(full) if parts else None, full)
        light = footer_inventory(df, read_footers(listing), parts)
        return _Sources(
            parquet_files(df, listing, parts),
            partitions(light) if parts else None,
            light,
            # Partition columns show in the paths alone.
            path_partitions(df, listing, parts) if parts else None,
        )
    except Exception as e:
        log.debug("no file inventory of %s: %s", name, e)
        return _Sources()


def table_overview(spark: SparkSession, catalog: str, namespace: str, table: str) -> Overview:
    """Look at a table from all sides.

    A missing table raises. Everything below its schema is optional: a view has no files, and only
    formats that keep commits have snapshots. Frames are lazy; each costs its scan when it is used.
    """
    name = checked_name(catalog, namespace, table)
    df = spark.table(name)
    ddl = spark.sql(f"SHOW CREATE TABLE {name}").first()[0]
    try:
        properties = spark.sql(f"SHOW TBLPROPERTIES {name}")
    except Exception:
        properties = None
    # The listings are capped; the headline numbers see all files and commits.
    commits = metadata_table(spark, name, "snapshots")
    found = _file_sources(spark, name, df)
    parts = metadata_table(spark, name, "partitions")
    return Overview(
        schema=df.schema.jsonValue(),
        ddl=ddl,
        properties=properties,
        profile=column_profile(df),
        snapshots=None if commits is None else snapshots(commits),
        partitions=found.partitions if parts is None else parts.limit(LISTED_ROWS),
        files=found.listed,
        measured={
            "snapshot_rows": commits,
            "file_rows": found.rows,
            "partition_rows": found.places if parts is None else parts,
            "df": df,
        },
    )
