"""Remove bytes that a 100-byte string covers which also starts earlier, through suffix arrays.

A suffix array of all documents does not fit a task, and need not: only strings of 100 bytes matter.

1. Every 100-byte window is named by the smallest hash of the 32-byte grams inside it. Windows in a row
   with the same name form a stretch of text. Equal windows have equal names, so they meet in the task
   that owns the name. Stretches that are alike are collapsed, within a task before the shuffle and
   then over all tasks: all but the earliest are repeats as a whole.
2. Names under which different stretches remain get their texts. Their windows that may repeat are
   sorted by a suffix array; suffixes that share 100 bytes follow each other in it, and all of them
   but the earliest are repeats.
3. Names with many different stretches, such as parts of licence lines, get their texts too, but their
   windows are told apart by the hash of all their bytes. Names with more than a task should hold are
   taken apart: each of their windows is a stretch of its own, named by that hash, and collapsed as in 1.
4. Each document's repeats are put together and its remaining bytes are hashed.

Disk: a window taken apart takes ten times the bytes of one that travels within its stretch, and the larger
the table, the more names have many stretches; hence the second way. Texts are shuffled only for documents
that a bitmap lets through, first those with stretches to compare, then those with repeats. The stages
before a stored table give their shuffle files back as soon as it is written.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefixes, groups
are processed in descending order through previous-smaller pointers, and the order inside the groups
is then emitted in one ascending pass, without recursion and renaming.

Defined results: a null text is empty; a text under 100 bytes loses nothing; documents come in the
order of doc_id, nulls first, and of their texts' hashes where doc_id is the same; rows alike in
doc_id and text count as one document and all get its numbers; an empty table gives no rows; other
columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlark.llm.hashing import _BASE, _BYTE, mixed, slices, text_bytes
from gridlark.llm.shingle_join import KEY_BITS, MOST_BITS
from gridlark.sources.scratch import scratch_path

LENGTH = 100
GRAM = 32
# Different stretches under one name beyond which its windows are told apart by hashes, and beyond which
# they are taken apart; a task holds 160 bytes and about 35 windows for each.
MANY = 64
TOO_MANY = 1 << 12
BLOCK_BYTES = 1 << 20

ENTRY = np.dtype([("name", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("inside", "?")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
STRETCH = np.dtype([("start", "<u4"), ("windows", "<u4"), ("name", "<u8"), ("way", "<u8")])


def suffix_order(text: bytes) -> np.ndarray:
    """Starts of the suffixes of ``text`` in ascending order."""
    n = len(text)
    # Groups in a chain from low to high, by first byte; members stay in text order.
    found: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        found[c].append(i)
    members = [m for m in found if m]
    size = [len(m) for m in members]
    lower, upper = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    top = len(members) - 1
    upper[top:] = [-1] if members else []
    done = bytearray(n)
    before = [-1] * n  # nearest place to the left in a lower group
    jump = [-1] * n  # the same, shortened as places get done
    g = top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                q = jump[p]
                if q >= 0 and done[q]:
                    q = jump[p] = jump[q]
                p = q
            before[i] = jump[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # What precedes a member goes to a group of its own above its old one: its Lyndon prefix
        # is longer by this group's, once for each member that it precedes.
        moved: dict[int, dict[int, list[int]]] = {}
        for p, t in times.items():
            moved.setdefault(t, {}).setdefault(group[p], []).append(p)
        for t in sorted(moved, reverse=True):
            for h, places in moved[t].items():
                if len(places) == size[h]:
                    continue
                new = len(members)
                members.append(places)
                size.append(len(places))
                size[h] -= len(places)
                for p in places:
                    group[p] = new
                above = upper[h]
                lower.append(h)
                upper.append(above)
                upper[h] = new
                lower[above] = new
        g = lower[g]
    # Second pass: ascending; whatever precedes a suffix already in place takes its group's next seat.
    order, seat, at = [0] * n, [0] * len(members), 0
    g = next((i for i, low in enumerate(lower) if low < 0), -1)
    while g >= 0:
        seat[g] = at
        at += size[g]
        g = upper[g]
    placed = bytearray(n)
    s = n - 1
    for i in range(-1, n):
        if i >= 0:
            s = order[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = 1
            h = group[s]
            order[seat[h]] = s
            seat[h] += 1
            s = before[s]
    return np.array(order, np.int64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on, put together from halves."""
    step = lambda n: np.uint64(pow(int(_BASE), n, 1 << 64))
    h, length, out, have, rest = _BYTE[data], 1, None, 0, size
    while rest:
        if rest & 1:
            n = len(data) - have - length + 1
            out = h if out is None else out[:n] * step(length) + h[have : have + n]
            have += length
        rest >>= 1
        if rest:
            n = len(data) - 2 * length + 1
            h = h[:n] * step(length) + h[length : length + n]
            length *= 2
    return mixed(out)


def smallest_in(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` numbers in a row."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _blocks(batches: Iterator[pa.RecordBatch]):
    """Bytes of some texts at a time: doc and text numbers, place in the text, bytes and bounds.

    A text beyond the block size comes in parts that overlap by all but one byte of a window.
    """
    for batch in batches:
        docs, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, bounds = text_bytes(batch.column(2))
        for a, b in slices(bounds, BLOCK_BYTES):
            low, high = bounds[a], bounds[b]
            if b == a + 1 and high - low > BLOCK_BYTES:
                for at in range(low, high - LENGTH + 1, BLOCK_BYTES):
                    end = min(high, at + BLOCK_BYTES + LENGTH - 1)
                    yield docs[a:b], marks[a:b], at - low, data[at:end], np.array([0, end - at])
            elif high - low >= LENGTH:
                yield docs[a:b], marks[a:b], 0, data[low:high], bounds[a : b + 1] - low


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, content hashes, starts, numbers of windows, texts, and whether a stretch may repeat itself.

    A window can only come again within a stretch if its smallest gram does: if a window starts with
    that gram and the next one still has the same smallest.
    """
    lengths = np.diff(bounds)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    valid = owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :]
    grams = gram_hashes(data, GRAM)
    name = smallest_in(grams, LENGTH - GRAM + 1)
    cut = np.ones(len(name), bool)
    cut[1:] = (name[1:] != name[:-1]) | (valid[1:] != valid[:-1]) | (owner[1 : len(name)] != owner[: len(name) - 1])
    cuts = np.append(np.flatnonzero(cut), len(name))
    goes_on = grams[: len(name)] == name
    goes_on[cuts[1:] - 1] = False
    inside = np.add.reduceat(goes_on, cuts[:-1], dtype=np.int64) > 0
    start, windows = cuts[:-1], np.diff(cuts)
    full = valid[start]
    start, windows, inside = start[full], windows[full], inside[full]
    upto = np.concatenate([[np.uint64(0)], np.cumsum(mixed(gram_hashes(data, LENGTH)))])
    content = mixed((upto[start + windows] - upto[start]) ^ windows.astype(np.uint64))
    return name[start], content, start - bounds[owner[start]], windows, owner[start], inside


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans of one document put together where they touch or overlap."""
    spans = np.sort(spans, order=["start", "end"])
    end = np.maximum.accumulate(spans["end"]) if len(spans) else spans["end"]
    first = np.ones(len(spans), bool)
    first[1:] = spans["start"][1:] > end[:-1]
    out = np.empty(int(first.sum()), SPAN)
    out["start"] = spans["start"][first]
    out["end"] = end[np.append(np.flatnonzero(first)[1:], len(spans)) - 1] if len(spans) else 0
    return out


def _by_document(doc: np.ndarray, text: np.ndarray, rows: np.ndarray, merge: bool) -> Iterator[tuple[int, int, bytes]]:
    """The rows of every document as bytes."""
    order = np.lexsort((text, doc))
    doc, text, rows = doc[order], text[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])) if len(doc) else []
    for a, b in zip(at, [*at[1:], len(doc)]):
        yield int(doc[a]), int(text[a]), (merged(rows[a:b]) if merge else rows[a:b]).tobytes()


def _covered(entries: np.ndarray) -> np.ndarray:
    spans = np.empty(len(entries), SPAN)
    spans["start"] = entries["start"]
    spans["end"] = entries["start"] + entries["windows"] + (LENGTH - 1)
    return spans


def collapse(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest entry of each name and content, sorted, and all the others."""
    entries = entries[np.lexsort((entries["start"], entries["text"], entries["doc"], entries["content"], entries["name"]))]
    first = np.ones(len(entries), bool)
    first[1:] = (entries["name"][1:] != entries["name"][:-1]) | (entries["content"][1:] != entries["content"][:-1])
    # Rows alike in doc_id and text bring the same entry twice; they are one document.
    again = np.zeros(len(entries), bool)
    again[1:] = entries[1:] == entries[:-1]
    return entries[first], entries[~first & ~again]


OUT = "kind int, bucket int, doc long, text long, payload binary"
ENTRIES, REPEATS, COMPARE, TEXTS, CROWDED = range(5)
# How a stretch is compared: by suffix arrays, by its windows' hashes, taken apart.
ARRAY, HASHES, APART = range(3)


def _row_batches(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    for at in range(0, len(rows), 20_000):
        columns = list(zip(*rows[at : at + 20_000]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "bucket", "doc", "text", "payload"]
        )


def _sent(entries: np.ndarray, buckets: int) -> list[tuple[int, int, int, int, bytes]]:
    """Collapsed entries by the bucket of their name, and the repeats by document."""
    kept, repeats = collapse(entries)
    bucket = (kept["name"] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, bucket = kept[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(kept) else []
    rows = [(ENTRIES, int(bucket[a]), 0, 0, kept[a:b].tobytes()) for a, b in zip(cuts, [*cuts[1:], len(kept)])]
    return rows + [
        (REPEATS, -1 - d % buckets, d, t, p) for d, t, p in _by_document(repeats["doc"], repeats["text"], _covered(repeats), True)
    ]


def _name_stretches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for docs, marks, base, data, bounds in _blocks(batches):
            name, content, start, windows, owner, inside = stretches(data, bounds)
            e = np.zeros(len(name), ENTRY)
            e["inside"] = inside
            e["name"], e["content"], e["start"], e["windows"] = name, content, start + base, windows
            e["doc"], e["text"] = docs[owner], marks[owner]
            parts.append(e)
        if parts:
            yield from _row_batches(_sent(np.concatenate(parts), buckets))

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "doc", "text", "payload"])


def _entries_of(group: pd.DataFrame) -> np.ndarray:
    raw = group.payload[group.kind == ENTRIES]
    return np.concatenate([np.empty(0, ENTRY), *(np.frombuffer(p, ENTRY) for p in raw)])


def _settle_names(many: int, too_many: int):
    """Repeats of a bucket of names, and the stretches to compare by their texts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept, repeats = collapse(_entries_of(group))
        rows = [(REPEATS, 0, d, t, p) for d, t, p in _by_document(repeats["doc"], repeats["text"], _covered(repeats), True)]
        if len(kept):
            starts = np.flatnonzero(np.concatenate([[True], kept["name"][1:] != kept["name"][:-1]]))
            number = np.diff(np.append(starts, len(kept)))
            number = np.repeat(number, number)
            wanted = (number > 1) | kept["inside"]
            open_, number = kept[wanted], number[wanted]
            s = np.empty(len(open_), STRETCH)
            s["start"], s["windows"], s["name"] = open_["start"], open_["windows"], open_["name"]
            s["way"] = np.where(number > too_many, APART, np.where(number > many, HASHES, ARRAY))
            rows += [(COMPARE, 0, d, t, p) for d, t, p in _by_document(open_["doc"], open_["text"], s, False)]
        rows += [(REPEATS, 0, d, t, p) for _, d, t, p in group.loc[group.kind == REPEATS, ["kind", "doc", "text", "payload"]].itertuples(index=False)]
        return _frame(rows)

    return run


def _fetch_texts(buckets: int):
    """Cut the stretches to compare out of their documents; take apart those of the most crowded names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, rows = [], {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for doc, mark, text, wanted in zip(*columns):
                raw = (text or "").encode()
                for s in np.concatenate([np.frombuffer(p, STRETCH) for p in wanted]):
                    a, n = int(s["start"]), int(s["windows"])
                    piece = raw[a : a + n + LENGTH - 1]
                    if s["way"] == APART:
                        h = gram_hashes(np.frombuffer(piece, np.uint8), LENGTH)
                        e = np.zeros(n, ENTRY)
                        e["name"] = e["content"] = h
                        e["doc"], e["text"], e["start"], e["windows"] = doc, mark, a + np.arange(n), 1
                        apart.append(e)
                    else:
                        head = np.array([(doc, mark, a, n)], PIECE).tobytes()
                        kind = TEXTS if s["way"] == ARRAY else CROWDED
                        rows.setdefault((kind, int(s["name"]) % buckets), []).append(head + piece)
        out = [(kind, b, 0, 0, b"".join(pieces)) for (kind, b), pieces in rows.items()]
        yield from _row_batches(out + (_sent(np.concatenate(apart), buckets) if apart else []))

    return run


PIECE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("windows", "<u4")])


def repeated_windows(pieces: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """Windows of the pieces that are not the earliest of their kind, as entries.

    A piece is (doc, text, start, bytes). Windows whose hash is the only one of its kind are left
    out first; the suffix array is built over what is left.
    """
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    lengths = np.array([len(p[3]) for p in pieces])
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(pieces)), lengths)
    valid = np.zeros(len(data), bool)
    valid[: len(data) - LENGTH + 1] = owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :]
    hashed = gram_hashes(data, LENGTH)
    at = np.flatnonzero(valid)
    _, which, number = np.unique(hashed[at], return_inverse=True, return_counts=True)
    at = at[number[which] > 1]
    if not len(at):
        return np.empty(0, ENTRY)
    # Bytes under the windows that are left, pushed together; each window keeps its bytes in a row.
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + LENGTH, -1)
    kept = np.cumsum(change[:-1]) > 0
    short = data[kept]
    window = np.zeros(len(data), bool)
    window[at] = True
    source, starts = np.flatnonzero(kept), np.flatnonzero(window[kept])
    is_start = np.zeros(len(short), bool)
    is_start[starts] = True
    order = suffix_order(short.tobytes())
    order = order[is_start[order]]
    alike = np.zeros(len(order), bool)
    spread = np.arange(LENGTH)
    for a in range(1, len(order), 20_000):
        here = order[a : a + 20_000]
        alike[a : a + len(here)] = (short[here[:, None] + spread] == short[order[a - 1 : a - 1 + len(here), None] + spread]).all(axis=1)
    kind = np.cumsum(~alike)
    place = source[order]
    piece = owner[place]
    e = np.zeros(len(order), ENTRY)
    e["name"] = e["content"] = kind
    e["doc"], e["text"] = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece]
    e["start"], e["windows"] = np.array([p[2] for p in pieces])[piece] + place - first[piece], 1
    return collapse(e)[1]


def hashed_windows(pieces: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """``repeated_windows`` by the windows' hashes alone."""
    bounds = np.concatenate([[0], np.cumsum([len(p[3]) for p in pieces])])
    found = []
    for a, b in slices(bounds, BLOCK_BYTES):
        data = np.frombuffer(b"".join(p[3] for p in pieces[a:b]), np.uint8)
        owner = np.repeat(np.arange(a, b, dtype=np.int32), np.diff(bounds[a : b + 1]))
        at = np.flatnonzero(owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :])
        inside = (at + bounds[a] - bounds[owner[at]]).astype(np.uint32)
        found.append((gram_hashes(data, LENGTH)[at], owner[at], inside))
    content, owner, inside = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(content)
    same = content[order[1:]] == content[order[:-1]]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    piece = owner[order]
    e = np.zeros(len(order), ENTRY)
    e["name"] = e["content"] = content[order]
    e["doc"], e["text"] = np.array([p[0] for p in pieces])[piece], np.array([p[1] for p in pieces])[piece]
    e["start"], e["windows"] = np.array([p[2] for p in pieces])[piece] + inside[order], 1
    return collapse(e)[1]


def _pieces(group: pd.DataFrame, kind: int) -> list[tuple[int, int, int, bytes]]:
    pieces = []
    for raw in group.payload[group.kind == kind]:
        at = 0
        while at < len(raw):
            doc, mark, start, windows = np.frombuffer(raw, PIECE, 1, at)[0].tolist()
            at += PIECE.itemsize
            pieces.append((doc, mark, start, raw[at : at + windows + LENGTH - 1]))
            at += windows + LENGTH - 1
    return pieces


def _settle_texts(group: pd.DataFrame) -> pd.DataFrame:
    _, repeats = collapse(_entries_of(group))
    for kind, repeated in ((TEXTS, repeated_windows), (CROWDED, hashed_windows)):
        if pieces := _pieces(group, kind):
            repeats = np.concatenate([repeats, repeated(pieces)])
    rows = [(REPEATS, 0, d, t, p) for d, t, p in _by_document(repeats["doc"], repeats["text"], _covered(repeats), True)]
    rows += [(REPEATS, 0, d, t, p) for _, d, t, p in group.loc[group.kind == REPEATS, ["kind", "doc", "text", "payload"]].itertuples(index=False)]
    return _frame(rows)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = (text or "").encode()
            found = merged(np.concatenate([np.empty(0, SPAN), *(np.frombuffer(p, SPAN) for p in spans or [])]))
            left, at = [], 0
            for a, b in found.tolist():
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            kept = b"".join(left)
            rows.append((doc, len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), found.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Queries run in here remove their shuffle files when they end; without, the files stay until the
    driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _told_apart(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that ``wanted``, a stored table, may name, and those that it does not; without a shuffle.

    A bitmap of the wanted documents' hashes, of bounded size, goes to all tasks. With more documents
    than it can tell apart more of the others are among the first; none that is wanted is among the rest.
    """
    bits = 1 << 15
    most = min(MOST_BITS, KEY_BITS * wanted.count())
    while bits < most:
        bits *= 2
    place = F.pmod(F.xxhash64("doc", "text"), F.lit(bits)) + 1
    bitmaps = (
        wanted.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    )
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = (
        docs.withColumn("place", place)
        .withColumn("bucket", F.bitmap_bucket_number("place"))
        .join(F.broadcast(bitmaps), "bucket", "left")
        .withColumn("named", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))
    )
    return marked.filter("named").select(*docs.columns), marked.filter(~F.col("named")).select(*docs.columns)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Rows of doc, text (numbers that name a document) and payload, packed spans; several for a document.

    ``docs``: doc, text (numbers), body.
    """
    spark, base = docs.sparkSession, scratch_path(docs.sparkSession, "suffixes")
    buckets = 4 * max(1, docs.rdd.getNumPartitions())
    named = docs.mapInArrow(_name_stretches(buckets), OUT).groupBy("bucket")
    settled = _stored(named.applyInPandas(_settle_names(MANY, TOO_MANY), OUT), f"{base}/names")
    compare = settled.filter(F.col("kind") == COMPARE)
    wanted = compare.groupBy("doc", "text").agg(F.collect_list("payload").alias("wanted"))
    near, _ = _told_apart(docs, compare)
    texts = near.join(wanted, ["doc", "text"]).select("doc", "text", "body", "wanted")
    compared = texts.mapInArrow(_fetch_texts(buckets), OUT).groupBy("bucket").applyInPandas(_settle_texts, OUT)
    repeats = settled.unionByName(_stored(compared, f"{base}/texts")).filter(F.col("kind") == REPEATS)
    return repeats.select("doc", "text", "payload")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (packed)."""
    least = -(2**63)
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("doc"),
        F.xxhash64("text").alias("text"),
        F.col("text").alias("body"),
    )
    found = repeated_spans(rows)
    spans = found.groupBy("doc", "text").agg(F.collect_list("payload").alias("spans"))
    near, rest = _told_apart(rows, found)
    known = near.join(spans, ["doc", "text"], "left").unionByName(rest.withColumn("spans", F.lit(None).cast("array<binary>")))
    return (
        known.select(F.when(F.col("doc") != least, F.col("doc")).alias("doc_id"), "body", "spans")
        .mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")
    )
