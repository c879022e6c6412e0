"""The trie of all conversations' prefixes: one row per node, with sums over its subtree.

1. Every conversation's turns are read in order, one conversation after the other, and each prefix gets
   a 128-bit digest: of the digest of the prefix before it and of the last turn.
2. Distinct digests are the nodes. Equal digests must agree in depth, parent and last turn; if two
   sequences ever shared one, the job fails instead of mixing them.
3. Conversations are dealt to shards. A shard's distinct digests get slots from a minimal perfect hash
   whose table keeps the digest of each slot, so that every look-up is verified. Own values of nodes are
   scattered into flat arrays by slot, and added to the parents' slots from the deepest level upward.
   A node is owned by the shard of its smallest member and counted there alone; other shards hold it
   with zeros. The shards' sums of one digest added up are the subtree's.

Hot prefixes are added up per task before they are shuffled, and a shard holds about ``SHARD_TURNS``
turns, or one longer conversation; its arrays take some 100 bytes for a turn. A conversation is read as a
stream, so its length does not matter before that. The ids that end at one node are hashed as a sorted
stream by one task, as their common SHA-256 demands, and never held.

Defined results: a null role or text is empty; turns are ordered null first, turns with one number by
the SHA-256 of role and text; repeated rows are turns each; rows without conv_id take no part; an empty
table has no nodes, not even the root; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.hashing import mixed
from gridlark.llm.mixing import words_of
from gridlark.sources.scratch import scratch_path

# Rebuilt conversations: those whose ids share all but the remainder modulo BLOCK begin like the
# block's first one, with up to MOST_SHARED - 1 of its turns.
BLOCK, MOST_SHARED = 20, 4
SHARD_TURNS = 50_000

PREFIXES = "conv_id long, depth int, d1 long, d2 long, p1 long, p2 long, turn long, words long, last boolean"
_NAMES = [c.split()[0] for c in PREFIXES.split(", ")]
_ROOT = hashlib.sha256(b"").digest()[:16]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), words: what the trie needs of each row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(said, 256)).alias("digest"),
        words_of(text).alias("words"),
    )


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def _by_conversation(turns: DataFrame) -> DataFrame:
    """All rows by conversation: first one that says what is taken over, then the turns in order."""
    first = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    heads = (
        turns.filter(F.col("conv_id") % BLOCK == 0)
        .withColumn("place", F.row_number().over(first))
        .filter(F.col("place") < MOST_SHARED)
        .groupBy(F.col("conv_id").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    )
    ids = turns.select("conv_id").distinct()
    block = F.col("conv_id") - F.col("conv_id") % BLOCK
    starts = ids.join(heads, block == F.col("block"), "left").select(
        "conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("words"),
        F.lit(0).alias("kind"), shared_turns(F.col("conv_id")).alias("take"), "head",
    )
    rest = turns.select("*", F.lit(1).alias("kind"), F.lit(0).alias("take"), F.lit(None).cast(starts.schema["head"].dataType).alias("head"))
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "digest"]
    rows = starts.unionByName(rest).repartition("conv_id").sortWithinPartitions(*order)
    return rows.select("conv_id", "digest", "words", "take", "head")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of the rebuilt conversations, from rows in order; state is one conversation's last prefix."""
    open_row, out = None, []
    two = struct.Struct("<qq").unpack

    def step(row: tuple, digest: bytes, words: int) -> tuple:
        conv, depth, state = row[0], row[1], row[-1]
        after = hashlib.sha256(state + digest).digest()[:16]
        return (conv, depth + 1, *two(after), *two(state), int.from_bytes(digest[:8], "little", signed=True), words, after)

    def push(last: bool) -> None:
        if open_row is not None:
            out.append((*open_row[:-1], last))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], _NAMES)
        out.clear()
        return batch.set_column(1, "depth", batch.column(1).cast(pa.int32()))

    skip = 0
    for batch in batches:
        for conv, digest, words, take, head in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None:
                push(True)
                open_row = (conv, 0, *two(_ROOT), 0, 0, 0, 0, _ROOT)
                skip = take
                for taken in (head or [])[:take]:
                    push(False)
                    open_row = step(open_row, taken["digest"], taken["words"])
            elif skip:
                skip -= 1
            else:
                push(False)
                open_row = step(open_row, digest, words)
        if out:
            yield flush()
    push(True)
    if out:
        yield flush()


def prefixes(rows: DataFrame, path: str) -> DataFrame:
    """Write and return all prefixes of all rebuilt conversations, one row per conversation and depth.

    ``d1, d2`` is the prefix's digest, ``p1, p2`` that of the prefix before it.
    """
    _by_conversation(turns_of(rows)).mapInArrow(_walk, PREFIXES).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def nodes(prefix_rows: DataFrame) -> DataFrame:
    """Distinct prefixes with the smallest member, the number of members and the last turn's words."""
    alike = ["depth", "p1", "p2", "turn", "words"]
    found = prefix_rows.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in alike],
        *[F.max(c).alias(f"{c}_most") for c in alike],
    )
    differ = F.lit(False)
    for c in alike:
        differ = differ | (F.col(c) != F.col(f"{c}_most"))
    checked = F.when(differ, F.raise_error(F.lit("two prefixes share a digest"))).otherwise(F.col("depth"))
    return found.select(
        "d1", "d2", "p1", "p2", checked.cast("long").alias("depth"), "conv_id", "n_convs", "words"
    )


class SlotTable:
    """Minimal perfect hash of distinct 128-bit keys, with the key of each slot kept for verification.

    Keys are hashed into twice as many places as there are keys; those alone in their place get the next
    slots, in the order of places, and the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys = np.empty_like(keys)
        left, used = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("keys of a slot table must be distinct")
            places = 2 * len(left)
            at = self._place(keys[left], len(self.levels), places)
            alone = np.bincount(at, minlength=places) == 1
            slots = used + np.cumsum(alone) - 1
            self.levels.append((alone, slots))
            here = alone[at]
            self.keys[slots[at[here]]] = keys[left[here]]
            used += int(alone.sum())
            left = left[~here]

    @staticmethod
    def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mixed(mixed(keys[:, 0] + seed) ^ keys[:, 1]) % np.uint64(places)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys; a key that the table does not hold is an error."""
        slot = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, slots) in enumerate(self.levels):
            at = self._place(keys[left], level, len(alone))
            here = alone[at]
            slot[left[here]] = slots[at[here]]
            left = left[~here]
        if len(left) or not np.array_equal(self.keys[slot], keys):
            raise ValueError("a key is not in the slot table")
        return slot


SUMS = "d1 long, d2 long, n_leaves long, saved_tokens long"


def _accumulate(shard: pa.Table) -> pa.Table:
    """Sums over subtrees inside a shard, one row per node."""
    column = lambda name: shard.column(name).to_numpy()
    pair = lambda a, b: np.stack([column(a), column(b)], axis=1).view(np.uint64)
    keys = pair("d1", "d2")
    table = SlotTable(keys)
    slot = table.find(keys)
    n = len(keys)
    depth, leaves, saved = np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth[slot], leaves[slot], saved[slot] = column("depth"), column("leaf"), column("saved")
    parent = np.full(n, -1, np.int64)
    below = column("depth") > 0
    parent[slot[below]] = table.find(pair("p1", "p2")[below])
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 2))
    for level in range(len(bounds) - 2, -1, -1):
        at = order[bounds[level] : bounds[level + 1]]
        np.add.at(leaves, parent[at], leaves[at])
        np.add.at(saved, parent[at], saved[at])
    names = table.keys.view(np.int64)
    return pa.table({"d1": names[:, 0].copy(), "d2": names[:, 1].copy(), "n_leaves": leaves, "saved_tokens": saved})


def subtree_sums(prefix_rows: DataFrame, owned: DataFrame, shards: int) -> DataFrame:
    """Rows of d1, d2, n_leaves, saved_tokens from nodes with ``leaf`` and ``saved`` of their own."""
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(shards)).cast("int").alias("shard")
    place = [shard, "d1", "d2", "p1", "p2", F.col("depth").cast("long").alias("depth")]
    none = F.lit(0).cast("long")
    held = prefix_rows.select(*place, none.alias("leaf"), none.alias("saved"))
    own = owned.select(*place, "leaf", "saved")
    distinct = (
        held.unionByName(own)
        .groupBy("shard", "d1", "d2")
        .agg(
            *[F.max(c).alias(c) for c in ("p1", "p2", "depth")],
            *[F.sum(c).alias(c) for c in ("leaf", "saved")],
        )
    )
    parts = distinct.groupBy("shard").applyInArrow(_accumulate, SUMS)
    return parts.groupBy("d1", "d2").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from rows sorted by node and id."""
    node, running, out = None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["d1", "d2", "ends_sha256"])
        out.clear()
        return batch

    for batch in batches:
        for d1, d2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if (d1, d2) != node:
                if node is not None:
                    out.append((*node, running.hexdigest()))
                node, running = (d1, d2), hashlib.sha256(str(conv).encode())
            else:
                running.update(b",%d" % conv)
        if out:
            yield flush()
    if node is not None:
        out.append((*node, running.hexdigest()))
        yield flush()


def end_hashes(prefix_rows: DataFrame) -> DataFrame:
    """Rows of d1, d2, ends_sha256: of the ids of the conversations that end at the node."""
    ends = prefix_rows.filter("last").select("d1", "d2", "conv_id")
    return ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(
        _hash_ends, "d1 long, d2 long, ends_sha256 string"
    )


def trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    spark = rows.sparkSession
    base = scratch_path(spark, "trie")
    all_prefixes = prefixes(rows, f"{base}/prefixes")
    shards = -(-max(1, all_prefixes.count()) // shard_turns)
    found = nodes(all_prefixes)
    found.write.parquet(f"{base}/nodes")
    found = spark.read.parquet(f"{base}/nodes")
    children = (
        found.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    known = found.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    owned = known.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("words")
    )
    sums = subtree_sums(all_prefixes, owned, shards)
    parents = found.select(
        F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("inner")
    )
    whole = known.join(sums, ["d1", "d2"]).join(end_hashes(all_prefixes), ["d1", "d2"], "left")
    inner = F.when(F.col("depth") > 0, F.lit(1))
    return whole.withColumn("inner", inner).join(parents, ["p1", "p2", "inner"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
