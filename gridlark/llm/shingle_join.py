"""Link documents whose sets of five-word shingles are alike, as a blocked sparse product.

The matrix of documents by shingles is never multiplied whole:

1. Documents of equal sets are one class, named by its smallest doc_id; only classes go on.
2. Sorted by hash, a set's first p shingles, p = size - ceil(0.75 size) + l, share at least l with
   those of any set it links with. Blocks of the hash space count which of them occur in two sets;
   a set with fewer shared ones than the smallest partner needs cannot link and is dropped; a bitmap of
   the others' hashes keeps its text out of the shuffle. Among the rest the same is done once more with
   whole sets, of which three quarters must be shared.
3. Among the rest each column (shingle) links its sets with one of them, the hub: first the one that
   shares most of its shingles with others. These pairs are counted exactly. Columns whose sets are then
   in one component are done, and so are sets that have fewer open columns left than a link needs.
4. The sets of the columns that remain meet by hub, in blocks of like sizes. The blocks' incidence matrix times its
   transpose gives all overlaps of two blocks at once; pairs below the bound for their sizes are
   discarded, and only the components that links bring together leave the task.

So links in large groups of near copies cost one pair per member, pairs inside a component are never
looked at, and no link between different components is missed.

Defined results: lower-casing touches A-Z only; a text of fewer than five words is one shingle; a null
or wordless text has an empty set and is its own component; a row without doc_id is linked with
nothing and has no component; rows with one doc_id are documents of that id each; an empty table gives
no rows; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.components import components
from gridlark.llm.hashing import hashes, mixed, slices, text_bytes
from gridlark.llm.memory import tidy
from gridlark.llm.names import fresh
from gridlark.sources.folder import Folder
from gridlark.sources.scratch import scratch_path

WIDTH = 5
PERCENT = 75
# Shared shingles asked of two prefixes, as a part of the set.
EXTRA = 0.1
CHUNK_BYTES = 1 << 20
# Entries that a task holds at once; they take some 80 bytes each while they are sorted.
FLUSH = 1_000_000
# Sets of a block and columns of a slice in step 4: a slice of two blocks takes 32 MB.
BLOCK = 512
COLUMNS = 8192
# Times that columns and sets are looked through for open ones before step 4.
ROUNDS = 3
# Bits of the filter that keeps rows without a wanted key out of a shuffle: for each key, and at most (8 MB).
KEY_BITS, MOST_BITS = 16, 1 << 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TURN = np.random.default_rng(5).integers(1, 2**63, WIDTH + 3, dtype=np.uint64) | np.uint64(1)


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap with any partner: 75 of 100, rounded up."""
    return -(-n * PERCENT // 100)


def extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n * EXTRA).astype(np.int64))


def prefix_length(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, n - needed(n) + extra(n))


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words of every text."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the size of each set."""
    data, bounds = text_bytes(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = _LOWER[data]
    starts, ends, counts = word_bounds(data, bounds)
    words = hashes(data, starts, ends)
    # A shingle of n words starts at every word that has n - 1 after it in its text.
    long = np.minimum(counts, WIDTH)
    shingles = np.where(counts > 0, counts - long + 1, 0)
    doc = np.repeat(np.arange(len(counts)), shingles)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(shingles) - shingles), shingles) + np.arange(len(doc))
    width = long[doc]
    sums = width.astype(np.uint64) * _TURN[WIDTH]
    for k in range(WIDTH):
        has = width > k
        sums[has] += words[first[has] + k] * _TURN[k]
    found = mixed(sums)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return found[keep], np.bincount(doc[keep], minlength=len(counts))


def set_marks(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per set that together name it; zero for an empty one."""
    marks = np.zeros((2, len(sizes)), np.uint64)
    full = sizes > 0
    at = (np.cumsum(sizes) - sizes)[full]
    for i in range(2):
        if len(at):
            marks[i, full] = mixed(np.add.reduceat(mixed(found ^ _TURN[WIDTH + 1 + i]), at) ^ sizes[full].astype(np.uint64))
    return marks[0].view(np.int64), marks[1].view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a, b in slices(text_bytes(batch.column(1))[1], CHUNK_BYTES):
            rows = batch.slice(a, b - a)
            yield rows.column(0), *shingle_sets(rows.column(1))


@tidy
def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for ids, found, sizes in _chunks([batch]):
            mark, mark2 = set_marks(found, sizes)
            texts = batch.column(2).slice(at, len(ids))
            at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, texts, pa.array(sizes), pa.array(mark), pa.array(mark2)],
                names=["doc_id", "text_hash", "n_shingles", "mark", "mark2"],
            )


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, int)
    return starts, np.diff(np.append(starts, len(values)))


def _prefix(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of all sets in a row, and the set of each."""
    kept = prefix_length(sizes)
    owner = np.repeat(np.arange(len(sizes)), kept)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept)
    return found[np.repeat(np.cumsum(sizes) - sizes, kept) + at], owner


# An entry in the shuffle: five bytes of the shingle's hash beyond its block, six of the set's mark.
# Equal bytes of different shingles would only keep a set that could be dropped.
VALUE_BYTES, OWNER_BYTES = 5, 6


def _packed(value: np.ndarray, owner: np.ndarray, blocks: int) -> bytes:
    rest = (value // np.uint64(blocks)).view(np.uint8).reshape(-1, 8)[:, :VALUE_BYTES]
    return np.concatenate([rest, owner.view(np.uint8).reshape(-1, 8)[:, :OWNER_BYTES]], axis=1).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(raw, np.uint8).reshape(-1, VALUE_BYTES + OWNER_BYTES)
    both = np.zeros((2, len(rows), 8), np.uint8)
    both[0, :, :VALUE_BYTES], both[1, :, :OWNER_BYTES] = rows[:, :VALUE_BYTES], rows[:, VALUE_BYTES:]
    return both[0].reshape(-1).view(np.int64), both[1].reshape(-1).view(np.int64)


def short_mark(mark: np.ndarray) -> np.ndarray:
    """The part of a mark that names an entry's owner; never 0, which stands for no owner."""
    return np.maximum(mark & ((1 << 8 * OWNER_BYTES) - 1), 1)


def _set_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """The same as ``_chunks`` from stored sets."""
    for batch in batches:
        sizes = batch.column("n").to_numpy()
        found = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
        yield batch.column("id"), np.concatenate([np.empty(0, np.uint64), *found]), sizes


def _blocks(blocks: int, chunks, part):
    """Entries of sets by block of the hash space; ``part`` chooses a set's entries.

    What a task sees twice among ``FLUSH`` entries is shared for certain: it counts at once and goes
    out once, without an owner. So a column sends at most one entry per flush, however many documents
    have it.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, owners, held = [], [], 0
        for _, found, sizes in chunks(batches):
            values, owner = part(found, sizes)
            seen.append(values)
            owners.append(short_mark(set_marks(found, sizes)[0])[owner])
            held += len(values)
            if held >= FLUSH:
                yield flush(np.concatenate(seen), np.concatenate(owners))
                seen, owners, held = [], [], 0
        if held:
            yield flush(np.concatenate(seen), np.concatenate(owners))

    def flush(value: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        # Copies of a set are one set.
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[keep], owner[keep]
        starts, lengths = _runs(value)
        many = np.repeat(lengths > 1, lengths)
        who, counts = np.unique(owner[many], return_counts=True)
        first = np.zeros(len(value), bool)
        first[starts] = True
        value, owner = value[first], np.where(many, 0, owner)[first]
        block = (value % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        value, owner, block = value[order], owner[order], block[order]
        at, lengths = _runs(block)
        numbers = [int(block[a]) for a in at]
        entries = [_packed(value[a : a + n], owner[a : a + n], blocks) for a, n in zip(at, lengths)]
        counted = np.stack([who, counts]).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*numbers, int(who[0]) % blocks if len(who) else 0], pa.int32()),
                pa.array([*([True] * len(entries)), False]),
                pa.array([*entries, counted], pa.binary()),
            ],
            names=["block", "entries", "payload"],
        )

    return run


def _shared(buckets: int):
    """Sets and how many of their entries in a block occur in another set, by bucket of the sets."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        value, owner = _unpacked(b"".join(group.payload[group.entries]))
        read = [np.frombuffer(p, np.int64).reshape(2, -1) for p in group.payload[~group.entries]]
        counted = np.concatenate([np.empty((2, 0), np.int64), *read], axis=1)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[keep], owner[keep]
        starts, lengths = _runs(value)
        zero = np.add.reduceat(owner == 0, starts) > 0 if len(starts) else np.empty(0, bool)
        owner = owner[np.repeat((lengths > 1) | zero, lengths)]
        who, counts = np.unique(owner[owner != 0], return_counts=True)
        both = np.concatenate([np.stack([who, counts]), counted], axis=1)
        bucket = both[0] % buckets
        both, bucket = both[:, np.argsort(bucket, kind="stable")], np.sort(bucket, kind="stable")
        at, lengths = _runs(bucket)
        return pd.DataFrame(
            {
                "bucket": bucket[at].astype(np.int32),
                "payload": [both[:, a : a + n].tobytes() for a, n in zip(at, lengths)],
            }
        )

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    both = np.concatenate([np.frombuffer(p, np.int64).reshape(2, -1) for p in group.payload], axis=1)
    who, which = np.unique(both[0], return_inverse=True)
    return pd.DataFrame({"short": who, "shared": np.bincount(which, both[1]).astype(np.int64)})


def _whole(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return found, np.repeat(np.arange(len(sizes)), sizes)


def _shared_counts(rows: DataFrame, blocks: int, chunks, part) -> DataFrame:
    """How many of a set's chosen entries occur in another set: short mark, shared."""
    return (
        rows.mapInArrow(_blocks(blocks, chunks, part), "block int, entries boolean, payload binary")
        .groupBy("block")
        .applyInPandas(_shared(-(-blocks // 2)), "bucket int, payload binary")
        .groupBy("bucket")
        .applyInPandas(_summed, "short long, shared long")
    )


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, found, sizes in _chunks(batches):
        ends = np.cumsum(sizes)
        sets = [found[a:b].tobytes() for a, b in zip(ends - sizes, ends)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(sets, pa.binary())], names=["id", "n", "set"])


@tidy
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (column, found, sizes), = _set_chunks([batch])
        value, owner = _prefix(found, sizes)
        ids, share = column.to_numpy(), batch.column("shared").to_numpy() / sizes
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(ids[owner]), pa.array(sizes[owner]), pa.array(share[owner].astype(np.float32))],
            names=["h", "id", "n", "share"],
        )


@tidy
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[place] == x))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        rows = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], names=["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link, by the exact overlap of their sets."""
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("left"))
    other = sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    return (
        pairs.select("a", "b")
        .join(one, "a")
        .join(other, "b")
        .select("a", "b", "left", "right")
        .mapInArrow(_links, "a long, b long")
    )


def _fits(a: str, b: str):
    """May sets of these sizes link?"""
    return (100 * F.least(a, b)) >= (PERCENT * F.greatest(a, b))


def _drop(spark: SparkSession, base: str, *names: str) -> None:
    """Remove stored tables that nothing reads any more."""
    folder = Folder(spark, base)
    for name in names:
        folder.remove(name)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur in ``wanted``, and a few others, without a shuffle of the rows.

    A bitmap of the wanted keys' hashes, of bounded size, goes to all tasks. With more keys than it can
    tell apart more rows pass; none that is wanted is ever left out. ``wanted`` is a stored table.
    """
    bits = 1 << 15
    most = min(MOST_BITS, KEY_BITS * wanted.count())
    while bits < most:
        bits *= 2
    (bucket, bitmap, place) = fresh(rows.columns, "bucket", "bitmap", "place")
    hashed = F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1
    bitmaps = (
        wanted.select(hashed.alias(place))
        .groupBy(F.bitmap_bucket_number(place).alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (
        rows.withColumn(place, hashed)
        .withColumn(bucket, F.bitmap_bucket_number(place))
        .join(F.broadcast(bitmaps), bucket)
        .filter(F.getbit(byte, (at % 8).cast("int")) == 1)
        .select(*rows.columns)
    )


def _alike(group: pd.DataFrame) -> pd.DataFrame:
    """Components that links between two blocks of sets bring together: rows of a, b.

    The blocks' incidence matrix, without columns that one set alone has, is multiplied with its
    transpose, some columns at a time. Each component is then led to the smallest it is linked with.
    """
    group = group.drop_duplicates("id")
    sets = [np.frombuffer(s, np.uint64) for s in group.set]
    sizes = np.array([len(s) for s in sets], np.int32)
    found, column, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[number[column] > 1], column[number[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, columns, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, columns - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        overlap += part @ part.T
    overlap = overlap.astype(np.int32)
    linked = 100 * overlap >= PERCENT * (sizes[:, None] + sizes[None, :] - overlap)
    names, own = np.unique(group.component.to_numpy(), return_inverse=True)
    x, y = np.nonzero(linked)
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, own[x], label[own[y]])
        np.minimum.at(new, own[y], label[own[x]])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


def _bound(n):
    """Prefix columns that a set of ``n`` shingles shares with any partner, the smallest one included."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * PERCENT / 100) * EXTRA))


def _seated(left: DataFrame) -> DataFrame:
    """Clusters and the sets that have to be in them: hub, id, n, component.

    The columns that a set shares with a partner lie with some of the hubs it has open columns of, k in
    all. One of these hubs holds a k-th of the shared columns at least, on either side; clusters where a
    set has fewer columns than a k-th of its bound can do without it.
    """
    counts = left.groupBy("hub", "id").agg(
        F.count(F.lit(1)).alias("columns"), F.max("n").alias("n"), F.min("component").alias("component")
    )
    hubs = counts.groupBy("id").agg(F.count(F.lit(1)).alias("hubs"))
    needed_here = F.col("columns") * F.col("hubs") >= _bound(F.col("n"))
    return counts.join(hubs, "id").filter(needed_here).select("hub", "id", "n", "component")


def _across(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share open columns; ``left``: h, id, n, hub, component.

    Any two sets that link are in one cluster. A cluster is cut into blocks by size class and component,
    and two blocks meet in one task unless their sizes are too far apart to link or they hold one and the
    same component.
    """
    members = _seated(left)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    place = F.row_number().over(Window.partitionBy("hub").orderBy(size_class, "component", "id"))
    members = members.withColumn("block", F.floor((place - 1) / BLOCK))
    blocks = members.groupBy("hub", "block").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    single = F.least("x.low", "y.low") == F.greatest("x.high", "y.high")
    near = (100 * F.col("x.most") >= PERCENT * F.col("y.least")) & (100 * F.col("y.most") >= PERCENT * F.col("x.least"))
    meetings = x.join(y, "hub").filter((F.col("x.block") <= F.col("y.block")) & ~single & near)
    sides = F.array_distinct(F.array("x.block", "y.block"))
    seats = meetings.select("hub", F.col("x.block").alias("one"), F.col("y.block").alias("two"), F.explode(sides).alias("block"))
    return (
        members.select("hub", "id", "component", "block")
        .join(seats, ["hub", "block"])
        .join(sets.select("id", "set"), "id")
        .groupBy("hub", "one", "two")
        .applyInPandas(_alike, "a long, b long")
    )


def _still_open(entries: DataFrame) -> DataFrame:
    """Prefix entries that may yet link two components: h, id, n, hub, component.

    Columns of one component are done. A link between components needs as many shared columns as the
    smallest partner's bound, and all of them are open; a set with fewer has no such link.
    """
    columns = entries.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    open_ = entries.join(columns.filter("low != high").select("h"), "h", "left_semi")
    enough = open_.groupBy("id").agg((F.count(F.lit(1)) >= _bound(F.max("n"))).alias("enough")).filter("enough")
    return open_.join(enough.select("id"), "id", "left_semi")


def _links_of(sets: DataFrame, base: str) -> DataFrame:
    """Enough links between the sets to connect all that are connected: rows of a, b."""
    entries = _stored(sets.mapInArrow(_entries, "h long, id long, n long, share float"), f"{base}/entries")
    # The hub is the set that shares most with others, such as the text that others are copies of.
    hubs = (
        entries.groupBy("h")
        .agg(F.min(F.struct((-F.col("share")).alias("by"), "id", "n")).alias("hub"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("h", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    # Stored, as it is read for the pairs and for the open columns.
    entries = _stored(entries.join(_stored(hubs, f"{base}/hubs"), "h").drop("share"), f"{base}/columns")
    _drop(sets.sparkSession, base, "entries", "hubs")
    pairs = entries.filter((F.col("id") != F.col("hub")) & _fits("n", "hub_n"))
    pairs = pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct()
    links = _stored(_verified(pairs, sets), f"{base}/links")
    named = components(links).withColumnRenamed("node", "id")
    left = entries.join(named, "id", "left").select(
        "h", "id", "n", "hub", F.coalesce("component", "id").alias("component")
    )
    for number in range(ROUNDS):
        left = _stored(_still_open(left), f"{base}/open-{number}")
        _drop(sets.sparkSession, base, "columns" if number == 0 else f"open-{number - 1}")
    across = _stored(_across(left, sets), f"{base}/across")
    _drop(sets.sparkSession, base, f"open-{ROUNDS - 1}")
    return links.union(across)


def _components_of(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, head.

    Documents of one component share ``head``, the doc_id and text of its first one, which tells
    components apart where doc_ids repeat; it is null for documents without words or id.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "shingles")
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    blocks = 2 * max(1, rows.rdd.getNumPartitions())
    known = _stored(
        rows.mapInArrow(_sizes, "doc_id long, text_hash long, n_shingles long, mark long, mark2 long"), f"{base}/sizes"
    )
    # Documents of equal sets are a class, numbered; its first document stands for it.
    short = F.greatest(F.col("mark").bitwiseAND((1 << 8 * OWNER_BYTES) - 1), F.lit(1))
    classes = _stored(
        known.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("mark", "mark2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .select("*", short.alias("short"), F.monotonically_increasing_id().alias("id")),
        f"{base}/classes",
    )
    smallest = F.ceil(F.col("n_shingles") * PERCENT / 100)
    some = F.greatest(F.lit(1), F.floor(smallest * EXTRA))
    alive = classes.join(_shared_counts(rows, blocks, _chunks, _prefix), "short").filter(F.col("shared") >= some)
    alive = _stored(alive.select("id", "short", "n_shingles", "first.doc_id", "first.text_hash"), f"{base}/alive")
    texts = _likely(rows, alive, "doc_id", "text_hash")
    texts = texts.join(alive.select("doc_id", "text_hash", "id"), ["doc_id", "text_hash"]).select("id", "text")
    found = _stored(texts.mapInArrow(_sets, "id long, n long, set binary"), f"{base}/found")
    close = alive.join(_shared_counts(found, blocks, _set_chunks, _whole), "short").filter(F.col("shared") >= smallest)
    close = _stored(close.select("id", "shared"), f"{base}/close")
    sets = _likely(found, close, "id").join(close, "id").filter("n > 0")
    # Rows alike in all have been read as often as they occur; a class has one set.
    sets = sets.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "set", "shared")])
    sets = _stored(sets, f"{base}/sets")
    _drop(spark, base, "found", "close")
    named = _stored(components(_links_of(sets, base)).withColumnRenamed("node", "id"), f"{base}/named")
    _drop(spark, base, "sets", "alive", "links", "across")
    linked = classes.join(named, "id").groupBy("component").agg(F.min("first").alias("first_of_all"))
    named = named.join(linked, "component").drop("component")
    classes = classes.join(named, "id", "left").select(
        "mark", "mark2", F.coalesce("first_of_all", "first").alias("head")
    )
    return known.join(classes, ["mark", "mark2"], "left").select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("head.doc_id"))
        .alias("component_id"),
        F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("head")).alias("head"),
    )


def similar_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components_of(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every component, with the input's columns: one with the smallest doc_id.

    Where rows share a doc_id, components are told apart by their texts, so none is lost. Rows without
    doc_id stay, as nothing links them; rows without words stay once for each doc_id and text.
    """
    (text_hash,) = fresh(docs.columns, "text_hash")
    own = F.struct("doc_id", "text_hash")
    first = _components_of(docs).filter("doc_id IS NOT NULL").filter(F.coalesce(F.col("head") == own, F.lit(True)))
    kept = first.select("doc_id", F.col("text_hash").alias(text_hash)).distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(text_hash, F.xxhash64("text"))
    found = named.join(kept, ["doc_id", text_hash], "left_semi").dropDuplicates(["doc_id", text_hash])
    return found.select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))
