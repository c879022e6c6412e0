"""The state of jobs, kept up to date while events arrive.

A stream writes the jobs that changed, batch by batch, into a change log. From time to time the log is
merged into the stored states: one row per job, in buckets of job ids. A merge writes the buckets that
changed into new folders and then, in one step, a new version that names the folders of all buckets and
the last batch they hold. Readers see the newest version whole, and batches after it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.operators.joblog import known_states, state_columns
from gridlark.sources.folder import Folder
from gridlark.sources.scratch import scratch_path

# Batches between merges, and buckets of job ids. A bucket is rewritten whole when a job of it changes.
MERGE_EVERY = 50
BUCKETS = 64

VERSION = "_version-{:012d}.json"


def job_state_stream(events: DataFrame) -> DataFrame:
    """The batch aggregate of job states over a streaming frame.

    There is no watermark: a late event still counts, and the state holds one row per job. Use the
    RocksDB state store when jobs outgrow executor memory.
    """
    return known_states(events).groupBy("job_id").agg(*state_columns())


def keep_job_state(
    events: DataFrame, changes: str, checkpoint: str, merge_every: int = MERGE_EVERY, buckets: int = BUCKETS
) -> None:
    """Drain the available events into the states under ``changes``, then return.

    Each micro-batch adds the jobs that changed under its own batch id; every ``merge_every`` batches
    they are merged. A batch that is repeated after a failure replaces its folder, or is left out if it
    has been merged before, so no change is lost or doubled.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            merge_changes(batch.sparkSession, changes, buckets)

    query = (
        job_state_stream(events)
        .writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _version(folder: Folder) -> dict:
    """The newest version: its number, the last batch it holds, and the folder of each bucket."""
    names = folder.named("_version-", ".json")
    return json.loads(folder.read(names[-1])) if names else {"number": 0, "upto": -1, "buckets": {}}


def _batches(folder: Folder, version: dict) -> list[int]:
    """Batches after the version, oldest first."""
    numbers = sorted(int(name.removeprefix("batch_id=")) for name in folder.named("batch_id=", ""))
    return [n for n in numbers if n > version["upto"]]


def _newest(log: DataFrame) -> DataFrame:
    """Of each job the row of its newest batch."""
    fields = [c for c in log.columns if c not in ("job_id", "batch_id")]
    newest = F.max_by(F.struct(*fields), F.col("batch_id"))
    return log.groupBy("job_id").agg(newest.alias("state")).select("job_id", "state.*")


def _read(spark: SparkSession, changes: str, version: dict, batches: list[int], only: set[str] | None = None) -> DataFrame:
    """Stored states and later batches; ``only`` names the buckets that are wanted."""
    stored = [f"{changes}/{path}" for bucket, path in version["buckets"].items() if only is None or bucket in only]
    frames = []
    if stored:
        frames.append(spark.read.parquet(*stored).withColumn("batch_id", F.lit(version["upto"])))
    if batches:
        later = [f"{changes}/batch_id={n}" for n in batches]
        frames.append(spark.read.option("basePath", changes).parquet(*later))
    if not frames:
        raise FileNotFoundError(f"no job states in {changes}")
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def merge_changes(spark: SparkSession, changes: str, buckets: int = BUCKETS) -> int:
    """Merge the batches since the last version into a new one; returns how many there were.

    Only buckets with a changed job are rewritten. Folders that no version names any more, and merged
    batches, are removed after the new version is in place; a merge that fails before changes nothing.
    """
    folder = Folder(spark, changes)
    version = _version(folder)
    batches = _batches(folder, version)
    if not batches:
        return 0
    buckets = version.get("of", buckets)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    log = spark.read.option("basePath", changes).parquet(*[f"{changes}/batch_id={n}" for n in batches])
    # At most as many rows as there are buckets.
    touched = {str(r.bucket) for r in log.select(bucket.alias("bucket")).distinct().collect()}
    rows = _read(spark, changes, version, batches, touched)
    place = f"states-{uuid.uuid4().hex[:12]}"
    merged = _newest(rows).withColumn("bucket", bucket)
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{changes}/_{place}")
    named = version["buckets"] | {b: f"_{place}/bucket={b}" for b in touched}
    number = version["number"] + 1
    following = {"number": number, "upto": batches[-1], "of": buckets, "buckets": named}
    folder.write(VERSION.format(number), json.dumps(following))
    for name in folder.named("_version-", ".json")[:-1]:
        folder.remove(name)
    for n in batches:
        folder.remove(f"batch_id={n}")
    used = {path.split("/")[0] for path in named.values()}
    for name in folder.named("_states-", ""):
        if name not in used:
            folder.remove(name)
    return len(batches)


def latest_job_state(spark: SparkSession, changes: str) -> DataFrame:
    """One row per job: stored states and what has changed since.

    Straight after a merge that is the stored rows as they lie.
    """
    folder = Folder(spark, changes)
    version = _version(folder)
    batches = _batches(folder, version)
    rows = _read(spark, changes, version, batches)
    return _newest(rows) if batches else rows.drop("batch_id")


def run_job_state(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Drain a stream of events into scratch space and return the final states."""
    changes = scratch_path(spark, "job-changes")
    keep_job_state(events, changes, scratch_path(spark, "job-checkpoint"))
    return latest_job_state(spark, changes)
