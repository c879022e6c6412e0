"""Draw the documents that look most like a target: importance resampling over hashed n-grams.

Features of a text are its runs of 1 to ``LONGEST`` words, each put into one of ``buckets`` by the
crc32 of its bytes. A bucket's gain is the logarithm of its share in the target over its share in
the documents; a document's weight is the sum of its features' gains; seeded Gumbel noise on top of
the weight makes the highest scores a sample without replacement.

Texts are read in batches. A batch's texts are joined with separators into one byte string, one
regular expression pass finds all words and separators, ``searchsorted`` on the offsets of these names
each word's text, and runs whose ends lie in different texts are masked before anything is counted. A run's
crc32 is put together from those of its words: crc32 is linear, so appending n bytes to a string
shifts its checksum by a table that depends on n alone.

Two passes read the texts: one counts buckets per task, the other adds up gains. Only bucket counts
(``buckets`` rows) come to the driver. The draw sorts narrow rows of numbers into ranges and reads
ranks from their places; nothing is sorted in one task.

Defined results: words are lower-cased in A-Z only; a null, empty or wordless text has no features
and weight 0; rows without doc_id take the noise of an empty id and lose ties; rows with one doc_id
are documents each, and rows alike in doc_id, score and counts take ranks next to each other; a
target or documents without features count as having none of each bucket; an empty table gives no
rows; other columns of the input do not matter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.hashing import slices, text_bytes
from gridlark.sources.scratch import scratch_path

# Stands between the texts of a batch; no byte of a text in UTF-8.
SEPARATOR = b"\xff"
# Words and separators; what ends a word.
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F\xFF]+|\xFF")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F\xFF]")
LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
# Bytes of texts joined at once, and bytes whose words are looked at at once; a longer text is one batch
# of its own.
BATCH_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20

_POLYNOMIAL = 0xEDB88320
_SPACE = zlib.crc32(b" ")
_SEPARATOR = zlib.crc32(SEPARATOR)


def _one_byte() -> np.ndarray:
    """Checksums after one more zero byte, for each byte value at each of the four places."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(_POLYNOMIAL), value >> 1)
    rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * (place - 1)) for place in (1, 2, 3)]
    return np.stack([value, *rest])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """Shift checksums by one table."""
    out = tables[0][crc & 255]
    for place in (1, 2, 3):
        out = out ^ tables[place][(crc >> np.uint32(8 * place)) & 255]
    return out


@lru_cache(maxsize=64)
def _power(k: int) -> np.ndarray:
    """The table for 2^k zero bytes."""
    return _one_byte() if k == 0 else _apply(_power(k - 1), _power(k - 1))


@lru_cache(maxsize=4096)
def _table(n: int) -> np.ndarray:
    """The table for n zero bytes."""
    value = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * place) for place in range(4)])
    for k in range(n.bit_length()):
        if n >> k & 1:
            value = _apply(_power(k), value)
    return value


def appended(crc: np.ndarray, tail: np.ndarray, tables: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Checksums of strings with their tails behind them; ``tables[which]`` fits each tail's length."""
    at = which * 1024
    flat = tables.reshape(-1)
    out = tail ^ flat[at + (crc & 255)]
    for place in (1, 2, 3):
        out ^= flat[at + 256 * place + ((crc >> np.uint32(8 * place)) & 255)]
    return out


def _tokens(joined: bytes) -> Iterator[list[bytes]]:
    """All words and separators in order, about ``CHUNK_BYTES`` of them at a time."""
    start = 0
    while start < len(joined):
        gap = BREAK.search(joined, start + CHUNK_BYTES)
        end = gap.start() if gap else len(joined)
        yield TOKEN.findall(joined, start, end)
        start = end


def runs(joined: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words in a run, text number, crc32) for all runs of 1 to ``LONGEST`` words inside a text.

    The last words of a chunk are kept for runs that end in the next one.
    """
    kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)]
    texts = 0
    for part in _tokens(joined):
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        crcs = np.fromiter(map(zlib.crc32, part), np.uint32, len(part))
        del part
        # Of all tokens of one byte the separator alone has its checksum.
        separator = (crcs == _SEPARATOR) & (lengths == 1)
        offsets, words = np.flatnonzero(separator), np.flatnonzero(~separator)
        fresh = len(kept[0])
        doc = np.concatenate([kept[0], texts + np.searchsorted(offsets, words)])
        texts += len(offsets)
        length = np.concatenate([kept[1], lengths[words]])
        crc = np.concatenate([kept[2], crcs[words]])
        different, which = np.unique(length, return_inverse=True)
        if not len(different):
            continue
        plain = np.stack([_table(int(k)) for k in different])
        spaced = np.stack([_table(int(k) + 1) for k in different])
        # Checksum of each word with the space before it.
        tail = appended(np.full(len(crc), _SPACE, np.uint32), crc, plain, which)
        run = crc
        yield 1, doc[fresh:], crc[fresh:]
        for size in range(2, LONGEST + 1):
            # run[i] covers words i to i + size - 2; one more word is appended.
            run = appended(run[: len(crc) - size + 1], tail[size - 1 :], spaced, which[size - 1 :])
            first = max(0, fresh - size + 1)
            same = doc[first : len(run)] == doc[first + size - 1 :]
            yield size, doc[first : len(run)][same], run[first:][same]
        kept = [a[-(LONGEST - 1) :] for a in (doc, length, crc)]


def _joined(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(number of texts, texts joined with separators), a batch of bytes at a time."""
    raw, bounds = text_bytes(texts)
    for start, end in slices(bounds, BATCH_BYTES):
        pieces = (raw[bounds[i] : bounds[i + 1]].tobytes() for i in range(start, end))
        # Bytes are lower-cased in A-Z only; bytes that are no UTF-8 must not look like a separator.
        yield end - start, SEPARATOR.join(p.replace(SEPARATOR, b"\xfe") for p in pieces).lower()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of bucket, n: features of all rows' ``text`` per bucket; only buckets that occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, joined in _joined(batch.column(0)):
                for _, _, crc in runs(joined):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    parts = texts.select("text").mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of each bucket in thousandths: how much likelier its features are in the target."""
    ours, theirs = (
        {row["bucket"]: row["n"] for row in bucket_counts(df, buckets).collect()} for df in (docs, target)
    )
    s_all, t_all = sum(ours.values()) + buckets, sum(theirs.values()) + buckets
    ratio = lambda b: (theirs.get(b, 0) + 1) * s_all / ((ours.get(b, 0) + 1) * t_all)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows of doc_id, n_words, n_features, weight: one per row of ``docs``."""
    buckets = len(gain)
    values = gain.astype(np.float64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for n, joined in _joined(batch.column(1)):
                words, features, weight = np.zeros((3, n), np.int64)
                for size, doc, crc in runs(joined):
                    counts = np.bincount(doc, minlength=n)
                    words += counts if size == 1 else 0
                    features += counts
                    # Sums of whole numbers: doubles hold them exactly.
                    sums = np.bincount(doc, weights=values[crc % np.uint32(buckets)], minlength=n)
                    weight += np.rint(sums).astype(np.int64)
                parts.append((words, features, weight))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        weigh, f"doc_id {kind}, n_words long, n_features long, weight long"
    )


def noise(doc_id: str, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, drawn from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def _in_order(scored: DataFrame, path: str) -> DataFrame:
    """``scored`` with ``place``, the row's number from 1 in the order of the draw."""
    spark = scored.sparkSession
    order = [
        F.col("open").desc(),
        F.col("score").desc(),
        F.col("doc_id").asc_nulls_last(),
        F.col("n_features"),
        F.col("weight"),
        # Cuts rows that are alike, however many, into several ranges.
        F.col("row"),
    ]
    numbered = scored.withColumn("row", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("range", F.shiftright("row", 33))
    # One row per range, as many as the shuffle has partitions.
    sizes = stored.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(F.broadcast(starts), "range").withColumn("place", F.col("start") + inside + 1)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; rank is null where not drawn.

    Of the documents with at least ``least_words`` words, ``percent`` of a hundred (rounded down) with
    the highest scores are drawn, ties to the smaller doc_id.
    """
    spark = docs.sparkSession
    base = scratch_path(spark, "resample")
    weighed = weights(docs, gains(docs, target, buckets))
    weighed.select(
        "*",
        (F.col("weight") + noise("doc_id", seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("open"),
    ).write.parquet(f"{base}/scored")
    scored = spark.read.parquet(f"{base}/scored")
    drawn = percent * scored.filter("open").count() // 100
    return _in_order(scored, f"{base}/ordered").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
    )


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """doc_id of the drawn documents in the order of the draw's ranks, with rank."""
    return resample(docs, target, **options).filter("rank IS NOT NULL").select("doc_id", "rank")
