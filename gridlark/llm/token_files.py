"""Token ids in Parquet files that can be read in part.

Documents are range-partitioned by doc_id, encoded and written in ascending order, one file per
partition. Ids are a list column with dictionary encoding, document numbers and offsets are delta
encoded; row groups and pages have a set size and page indexes, so that a reader finds some
documents, or the numbers alone, without reading the rest.

Texts are encoded by pieces: a byte-level BPE never joins what stands before a single space, or a
letter before a punctuation mark, to what follows. So the ids of a text are those of its pieces in a
row, and each distinct piece goes through the tokenizer once per worker. Tests compare with whole
texts.

Defined results: a null text counts as empty; an empty text is the end id alone; a null doc_id comes
first; rows with the same doc_id follow each other in the order of their texts; other columns of the
input are not written; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlark.llm.hashing import hashes, slices, text_bytes
from gridlark.llm.memory import tidy

FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens int, ids array<int>"
END_ID = 2
# Distinct pieces that a worker remembers, at about 40 bytes each, bytes of text it takes at once, at some
# 60 bytes each, and pieces that the tokenizer gets in one call, whose encodings take about 1 kB each.
MOST_PIECES = 1_500_000
CHUNK_BYTES = 1 << 20
CALL_PIECES = 20_000

# Bytes that are whitespace, or that may begin a character that is.
_SPACE_LIKE = np.zeros(256, bool)
_SPACE_LIKE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
# Letters of ASCII, and marks that no special token such as <|...|> or [...] begins or ends with.
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[list(b"!\"#$%&'()*+,-./:;=?@")] = True


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start: at every text, at each single space between two other characters, and
    where a mark follows a letter."""
    spaces = np.flatnonzero(data[1:-1] == 0x20) + 1
    before, after = data[spaces - 1], data[spaces + 1]
    lead2, lead3 = data[np.maximum(spaces - 2, 0)], data[np.maximum(spaces - 3, 0)]
    wide = (before >= 0x80) & ((lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3)))
    plain = ~_SPACE_LIKE[after] & ~(_SPACE_LIKE[before] & (before < 0x80)) & ~wide
    texts = bounds[:-1][np.diff(bounds) > 0]
    marks = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    starts = np.sort(np.concatenate([spaces[plain], texts, marks]), kind="stable")
    return starts[np.diff(starts, prepend=-1) > 0]


class PieceEncoder:
    """Encodes batches of texts; every distinct piece once, as long as it is remembered."""

    def __init__(self, tokenizer_file: str, most_pieces: int = MOST_PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.most_pieces = most_pieces
        self._forget()

    def _forget(self) -> None:
        self.known, self.row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are not remembered, some pieces a call, and the number of ids of each."""
        raw, flat, sizes = data.tobytes(), [], []
        for at in range(0, len(starts), CALL_PIECES):
            some = slice(at, at + CALL_PIECES)
            pieces = [raw[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The remembered row of every piece; new pieces are encoded."""
        found, first, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, found)
        new = np.ones(len(found), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != found[inside]
        if new.any():
            ids, lengths = self._new(data, starts[first[new]], ends[first[new]])
            rows = len(self.bounds) - 1 + np.arange(len(lengths))
            self.flat = np.concatenate([self.flat, ids])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.known = np.insert(self.known, place[new], found[new])
            self.row = np.insert(self.row, place[new], rows)
            place = np.searchsorted(self.known, found)
        return self.row[place][which]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and the number of ids of each."""
        if len(self.known) > self.most_pieces:
            self._forget()
        data, bounds = text_bytes(texts)
        starts = piece_starts(data, bounds)
        rows = self._rows(data, starts, np.append(starts[1:], len(data)))
        sizes = self.bounds[rows + 1] - self.bounds[rows]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.bounds[rows] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
        upto = np.concatenate([[0], ends])[np.searchsorted(starts, bounds[1:])]
        return np.insert(ids, upto, end_id), np.diff(upto, prepend=0) + 1


@cache
def _worker_encoder(tokenizer_file: str) -> PieceEncoder:
    """One encoder for all tasks of a worker process: what it remembers helps the next task."""
    return PieceEncoder(tokenizer_file)


def _encoder(tokenizer_file: str, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _worker_encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b in slices(text_bytes(batch.column(1))[1], CHUNK_BYTES):
                rows = batch.slice(a, b - a)
                ids, lengths = encoder.encode(rows.column(1), end_id)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array(np.full(len(lengths), part, np.int32)),
                        pa.array(start + ends - lengths),
                        pa.array(lengths.astype(np.int32)),
                        pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(lengths.sum())

    return run


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = END_ID,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 64 << 10,
    page_rows: int = 1000,
) -> None:
    """Encode ``docs`` and write them in ascending doc_id order as a folder of Parquet files."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(_encoder(tokenizer_file, end_id), FILE_SCHEMA)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """Rows of the files; with ``doc_ids`` the filter reaches row groups and page indexes."""
    rows = spark.read.parquet(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each file: one row per file, from two narrow columns."""
    sizes = (
        spark.read.parquet(path)
        .groupBy("part")
        .agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("n"))
    )
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


@tidy
def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = lists.values.to_numpy().astype("<i4", copy=False)
        bounds = lists.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(3)]
            + [pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
        )


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    sums = spark.read.parquet(path).select("doc_id", "part", "part_start", "ids").mapInArrow(
        _checksums, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long"
    )
    return sums.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )
