"""MERGE and DELETE on Parquet tables by copy on write of the touched files.

1. A scan of the key columns joins the changes and keeps (key, file) of each hit; the files of these are
   the touched ones.
2. Rows of the touched files, changed or as they are, and rows to insert are written into a hidden folder
   below the table's.
3. The new files are moved to their places and the touched ones removed. What is to be done is written
   down before the first step of that; ``recover`` finishes what was interrupted.

Files without a hit are neither read beyond their key columns nor written. Readers that list the folder
during step 3 may see some files of both states, as plain Parquet has no log of versions; a job that
fails before step 3 leaves the table as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.functions.text import checked_name
from gridlark.functions.values import quoted
from gridlark.sources.folder import Folder
from gridlark.sources.scratch import scratch_path

# Names that start with an underscore are no data to readers of a folder.
STAGED, PLAN = "_merge-{}", "_merge-{}.json"


@dataclass(frozen=True)
class Merged:
    """What a merge did: rows found and changed, rows added, files rewritten (as listed) and made."""

    matched: int
    inserted: int
    touched: list[str]
    made: list[str]


def _location(spark: SparkSession, name: str) -> tuple[str, list[str]]:
    """Folder and partition columns of a Parquet table."""
    details = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    if (details.get("Provider") or "").lower() != "parquet":
        raise ValueError(f"{name} is no Parquet table")
    return details["Location"], [c.name for c in spark.catalog.listColumns(name) if c.isPartition]


def _file() -> Column:
    return F.col("_metadata.file_path")


def _finish(folder: Folder, plan_name: str) -> None:
    """Do what a plan says; steps that were done before are left out."""
    plan = json.loads(folder.read(plan_name))
    for name in plan["made"]:
        folder.move(f"{plan['staged']}/{name}", name)
    for name in plan["touched"]:
        folder.remove(name)
    folder.remove(plan["staged"])
    folder.remove(plan_name)


def recover(spark: SparkSession, name: str) -> int:
    """Finish merges that were interrupted while files were exchanged; returns how many."""
    name = checked_name(name)
    folder = Folder(spark, _location(spark, name)[0])
    plans = folder.named("_merge-", ".json")
    for plan in plans:
        _finish(folder, plan)
    _refresh(spark, name)
    return len(plans)


def _refresh(spark: SparkSession, name: str) -> None:
    if _location(spark, name)[1]:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    spark.sql(f"REFRESH TABLE {name}")


def _relative(folder: Folder, encoded: Sequence[str]) -> list[str]:
    """Paths as ``_metadata`` spells them, relative to the folder and without encoding."""
    uri = folder.jvm.java.net.URI
    root = folder.fs.makeQualified(folder.at(folder.path)).toUri().getPath()
    return sorted(uri(path).getPath()[len(root) + 1 :] for path in encoded)


def _exchange(
    spark: SparkSession, name: str, location: str, parts: Sequence[str], rows: DataFrame, touched: Sequence[str]
) -> tuple[list[str], list[str]]:
    """Write rows as new files and put them into the place of the touched ones."""
    folder, mark = Folder(spark, location), uuid.uuid4().hex[:12]
    staged = STAGED.format(mark)
    writer = rows.hint("rebalance", *parts) if parts else rows.hint("rebalance")
    writer.write.partitionBy(*parts).parquet(f"{folder.path}/{staged}")
    made, old = folder.files(f"{folder.path}/{staged}"), _relative(folder, touched)
    plan = PLAN.format(mark)
    folder.write(plan, json.dumps({"staged": staged, "made": made, "touched": old}))
    _finish(folder, plan)
    _refresh(spark, name)
    return old, made


def merge_rows(
    spark: SparkSession,
    name: str,
    changes: DataFrame,
    on: Sequence[str],
    delete_when: Column | None = None,
) -> Merged:
    """Rows of the table whose key is among the changes take their values; other changes are added.

    ``changes`` has the table's columns and at most one row for each key, else the merge is refused, as
    MERGE refuses a row that is matched twice. Where ``delete_when``, a condition over the changes, is
    true, matched rows are removed and nothing is added. A null in a key equals nothing, so such changes
    are added. Changes that touch no row rewrite no file.
    """
    name = checked_name(name)
    location, parts = _location(spark, name)
    target = spark.table(name)
    on, columns = list(on), target.columns
    base = scratch_path(spark, "merge")
    gone = F.coalesce(delete_when, F.lit(False)) if delete_when is not None else F.lit(False)
    # Stored once, so that all steps see the same changes.
    numbered = [F.col(quoted(c)).cast(target.schema[c].dataType).alias(f"new_{i}") for i, c in enumerate(columns)]
    keys = [f"new_{columns.index(k)}" for k in on]
    changes.select(*numbered, gone.alias("gone")).write.parquet(f"{base}/changes")
    changes = spark.read.parquet(f"{base}/changes")
    known = changes.dropna(subset=keys)
    if not known.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("changes hold a key more than once")
    same = [F.col(quoted(k)) == F.col(n) for k, n in zip(on, keys)]
    hits = target.select(*map(quoted, on), _file().alias("file")).join(known.select(*keys), same).groupBy(*keys, "file")
    hits.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/hits")
    hits = spark.read.parquet(f"{base}/hits")
    touched = [r.file for r in hits.select("file").distinct().collect()]
    added = changes.filter(~F.col("gone")).join(hits.select(*keys).distinct(), keys, "left_anti")
    # One path list in the filter: the scan opens the touched files alone.
    kept = target.where(_file().isin(touched)) if touched else target.where(F.lit(False))
    joined = kept.join(known.withColumn("hit", F.lit(True)), same, "left").filter(~F.coalesce("gone", F.lit(False)))
    value = lambda i, c: F.when(F.col("hit"), F.col(f"new_{i}")).otherwise(F.col(quoted(c))).alias(c)
    rewritten = joined.select(*[value(i, c) for i, c in enumerate(columns)])
    fresh = added.select(*[F.col(f"new_{i}").alias(c) for i, c in enumerate(columns)])
    matched = hits.agg(F.sum("n")).first()[0] or 0
    inserted = added.count()
    if not touched and not inserted:
        return Merged(0, 0, [], [])
    old, made = _exchange(spark, name, location, parts, rewritten.unionByName(fresh), touched)
    return Merged(matched, inserted, old, made)


def delete_rows(spark: SparkSession, name: str, condition: Column) -> Merged:
    """Remove the rows for which the condition is true; files without such rows stay as they are."""
    name = checked_name(name)
    location, parts = _location(spark, name)
    target = spark.table(name)
    found = target.where(condition).groupBy(_file().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    touched = [r.file for r in found]
    if not touched:
        return Merged(0, 0, [], [])
    kept = target.where(_file().isin(touched)).where(~F.coalesce(condition, F.lit(False)))
    old, made = _exchange(spark, name, location, parts, kept, touched)
    return Merged(sum(r.n for r in found), 0, old, made)
