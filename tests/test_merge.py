"""Merges and deletes on Parquet tables: rows against a plain version, and which files stay."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from gridlark.sources import merge, scratch
from gridlark.sources.folder import Folder


@pytest.fixture(scope="module")
def namespace(spark):
    return scratch.scratch_namespace(spark, f"gridlark_merge_{uuid.uuid4().hex[:8]}")


def made(spark, namespace, label, parts=None, n=80, files=8):
    name = f"{namespace}.{label}"
    rows = spark.range(n).selectExpr("id AS k", "concat('v', id) AS v", "CAST(id % 3 AS INT) AS p")
    writer = rows.repartitionByRange(files, "k").write
    (writer.partitionBy(*parts) if parts else writer).saveAsTable(name)
    return name


def files_of(spark, name):
    paths = spark.table(name).select("_metadata.file_path", "_metadata.file_modification_time").distinct().collect()
    return {tuple(r) for r in paths}


CHANGES = "k LONG, v STRING, p INT"


def test_one_row_leaves_all_other_files(spark, namespace):
    name = made(spark, namespace, "one")
    before = files_of(spark, name)
    done = merge.merge_rows(spark, name, spark.createDataFrame([(17, "new", 9)], CHANGES), ["k"])
    after = files_of(spark, name)
    assert (done.matched, done.inserted, len(done.touched), len(done.made)) == (1, 0, 1, 1)
    assert len(before) == 8 and len(before & after) == 7 and len(after) == 8
    assert spark.table(name).count() == 80
    assert tuple(spark.table(name).where("k = 17").first()) == (17, "new", 9)


@pytest.mark.parametrize("parts", [None, ["p"]])
def test_merge_is_plain_merge(spark, namespace, parts):
    rng = random.Random(2)
    name = made(spark, namespace, f"plain_{'parts' if parts else 'flat'}", parts)
    state = [(i, f"v{i}", i % 3) for i in range(80)]
    # Repeated and missing keys in the table, odd partition values and deletes among the changes.
    extra = [(5, "again", 1), (None, "no key", 2)]
    spark.createDataFrame(extra, CHANGES).write.mode("append").format("parquet").partitionBy(*(parts or [])).saveAsTable(name)
    state += extra
    for turn in range(3):
        keys = rng.sample(range(0, 120), 25) + [5]
        changes = [(k, rng.choice(["a", "gone", None]), rng.choice([0, 1, 7, None])) for k in set(keys)] + [(None, f"n{turn}", 0)]
        merge.merge_rows(spark, name, spark.createDataFrame(changes, CHANGES), ["k"], delete_when=F.col("v") == "gone")
        new = {c[0]: c for c in changes if c[0] is not None}
        held = {r[0] for r in state}
        state = [new.get(r[0], r) for r in state if new.get(r[0], r)[1] != "gone" or r[0] not in new]
        state += [c for c in changes if c[1] != "gone" and (c[0] is None or c[0] not in held)]
        got = sorted(map(str, (tuple(r) for r in spark.table(name).select("k", "v", "p").collect())))
        assert got == sorted(map(str, state))


def test_nothing_to_do_changes_nothing(spark, namespace):
    name = made(spark, namespace, "idle")
    before = files_of(spark, name)
    nothing = spark.createDataFrame([(500, "gone", 1)], CHANGES)
    assert merge.merge_rows(spark, name, nothing, ["k"], delete_when=F.lit(True)) == merge.Merged(0, 0, [], [])
    assert merge.merge_rows(spark, name, nothing.limit(0), ["k"]) == merge.Merged(0, 0, [], [])
    assert merge.delete_rows(spark, name, F.col("k") > 900) == merge.Merged(0, 0, [], [])
    assert files_of(spark, name) == before


def test_keys_must_be_unique_and_names_safe(spark, namespace):
    name = made(spark, namespace, "twice")
    twice = spark.createDataFrame([(1, "a", 0), (1, "b", 0)], CHANGES)
    with pytest.raises(ValueError, match="more than once"):
        merge.merge_rows(spark, name, twice, ["k"])
    with pytest.raises(ValueError, match="safe"):
        merge.merge_rows(spark, f"{name}; DROP TABLE x", twice, ["k"])
    assert spark.table(name).count() == 80


def test_delete_keeps_other_files(spark, namespace):
    name = made(spark, namespace, "less", ["p"])
    before = files_of(spark, name)
    done = merge.delete_rows(spark, name, (F.col("p") == 1) & (F.col("k") < 10))
    assert done.matched == 3 and all(t.startswith("p=1/") for t in done.touched)
    after = files_of(spark, name)
    assert {f for f in before if "/p=1/" not in f[0]} <= after
    assert spark.table(name).count() == 77
    assert merge.delete_rows(spark, name, F.lit(True)).matched == 77
    assert spark.table(name).count() == 0


def test_a_failed_merge_leaves_the_table_and_an_interrupted_one_is_finished(spark, namespace, monkeypatch):
    name = made(spark, namespace, "broken", ["p"])
    rows = lambda: {tuple(r) for r in spark.table(name).collect()}
    before = rows()
    change = spark.createDataFrame([(3, "new", 2), (100, "added", 5)], CHANGES)
    failing = change.withColumn("v", F.when(F.col("k") > 0, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        merge.merge_rows(spark, name, failing, ["k"])
    assert rows() == before
    moves = []

    def move(self, old, new):
        moves.append(new)
        if len(moves) > 1:
            raise OSError("gone")
        return moved(self, old, new)

    moved = Folder.move
    monkeypatch.setattr(Folder, "move", move)
    with pytest.raises(OSError, match="gone"):
        merge.merge_rows(spark, name, change, ["k"])
    monkeypatch.undo()
    assert merge.recover(spark, name) == 1
    assert rows() == {r for r in before if r[0] != 3} | {(3, "new", 2), (100, "added", 5)}
    assert merge.recover(spark, name) == 0


def test_only_touched_files_are_scanned(spark, namespace):
    name = made(spark, namespace, "scanned")
    one = spark.table(name).where("k = 3").select("_metadata.file_path").first()[0]
    scan = spark.table(name).where(F.col("_metadata.file_path").isin([one]))
    scan.collect()
    nodes = [scan._jdf.queryExecution().executedPlan()]
    while "numFiles" not in str(nodes[-1].metrics().keys()):
        nodes.append(nodes[-1].children().apply(0))
    assert nodes[-1].metrics().apply("numFiles").value() == 1
