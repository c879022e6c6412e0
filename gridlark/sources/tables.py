"""Parquet tables in a folder, one ``<name>.parquet`` per table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def attach(spark: SparkSession, folder: str, names: Iterable[str]) -> SparkSession:
    """Make the named tables visible to SQL text as temporary views."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
    return spark


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """The same table as a file stream; works for a single file and for a folder of part files.

    The one-letter character class makes the path a glob, which the file source accepts for a
    single file too.
    """
    schema = table(spark, folder, name).schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}.parque[t]")
    )
