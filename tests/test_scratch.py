"""Scratch space and sources."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from gridlark.operators import ordered
from gridlark.session import scratch_root
from gridlark.sources import scratch
from gridlark.sources.tables import stream_table


def test_cluster_must_name_its_folder():
    conf = SimpleNamespace(get=lambda key, default: default)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(session)


def test_folder_comes_from_the_setting():
    conf = SimpleNamespace(get=lambda key, default: "hdfs://shared/dir/")
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="app-1"))
    assert scratch_root(session) == "hdfs://shared/dir"
    assert scratch.scratch_path(session, "x").startswith("hdfs://shared/dir/gridlark_app_1/x-")


def test_folder_in_use_is_taken_over():
    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: "hdfs://shared/used")
    assert scratch_root(SimpleNamespace(conf=conf, sparkContext=context)) == "hdfs://shared/used"


def test_local_session_without_the_setting_makes_one_folder():
    made = []
    context = SimpleNamespace(
        master="local[2]", setCheckpointDir=made.append, getCheckpointDir=lambda: made[0] if made else None
    )
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    assert scratch_root(session) == scratch_root(session) == made[0]
    assert len(made) == 1


def test_scratch_is_cleared(spark):
    root = Path(scratch_root(spark).removeprefix("file:")) / scratch._own_name(spark)
    df = spark.range(100).selectExpr("id", "id % 3 AS k")
    assert ordered.ranked(df, ["k"], ["id"], [], 10).count() == 100
    spark.range(3).write.saveAsTable(f"{scratch.scratch_namespace(spark)}.some_table")
    assert any(root.iterdir())
    scratch.clear_scratch(spark)
    assert not root.exists()


def test_stream_reads_a_file_and_a_folder(spark, tmp_path):
    for name, parts in (("one", 1), ("many", 3)):
        spark.range(30).repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
        seen = []
        query = (
            stream_table(spark, str(tmp_path), name, files_per_batch=1)
            .writeStream.foreachBatch(lambda batch, i: seen.append(batch.count()))
            .option("checkpointLocation", str(tmp_path / f"{name}-check"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        assert sum(seen) == 30 and len(seen) == parts
