"""Quality scores from compression with dictionaries of good and of bad texts.

Two zstandard dictionaries are trained, one on texts labelled good and one on texts labelled bad. A
text that resembles the good ones takes fewer bytes with the first than with the second. The
normalised difference of the two sizes, with the sizes per byte, becomes a probability through a
logistic regression fitted on labelled texts that the dictionaries have not seen. It is the
probability under about equal shares of both classes, as sampled.

The whole text is compressed, in consecutive pieces of about ``PIECE_BYTES``, each with the dictionaries
afresh, and the sizes are added up; so a long text is scored like its pieces, whatever its length. Labels are learnt from a sample of at most ``PER_CLASS`` documents of
each class, of at most ``LONGEST`` characters, drawn from the rows that are not held out.

Defined results: a null text counts as empty; an empty text gets the score of a text without any
evidence, the same each time; without labels of both classes every score is 0.5; every row gets one
row; an empty table gives none; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.labelled import remainder, sample
from gridlark.llm.memory import tidy

MODULUS, HELD = 5, 0
THRESHOLD = 0.3
PER_CLASS = 2400
LONGEST = 20_000
DICTIONARY_BYTES = 110 << 10
SAMPLE_BYTES = 4000
# Pieces are as long as the samples that the dictionaries are trained on.
PIECE_BYTES = SAMPLE_BYTES
LEVEL = 3


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too few samples to train on, the samples themselves."""
    parts = [t[i : i + SAMPLE_BYTES] for t in texts for i in range(0, len(t), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY_BYTES:]


def pieces(data: bytes) -> list[bytes]:
    """The text in consecutive pieces of equal length; a text of up to 1.5 pieces is one."""
    number = max(1, round(len(data) / PIECE_BYTES))
    ends = [len(data) * i // number for i in range(number + 1)]
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, write_content_size=False)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None

    @cached_property
    def _compressors(self):
        return _compressor(self.good), _compressor(self.bad), zstandard.ZstdCompressor(level=LEVEL)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def difference(self, text: str) -> tuple[float, ...]:
        """The normalised size difference, and the sizes per byte with either dictionary and without."""
        parts = pieces(text.encode())
        good, bad, plain = (sum(len(c.compress(p)) for p in parts) for c in self._compressors)
        # The length of a piece: what a text's length tells ends where it is cut.
        mean = sum(map(len, parts)) / len(parts) + 16
        n = mean * len(parts)
        return (bad - good) / (bad + good), good / n, bad / n, plain / n, np.log(min(mean, PIECE_BYTES))

    def _expanded(self, rows: list[tuple[float, ...]]) -> np.ndarray:
        x = np.array(rows).reshape(-1, 5)
        pairs = [x[:, i] * x[:, j] for i in range(5) for j in range(i, 5)]
        return np.column_stack([x, *pairs])

    def calibrate(self, texts: list[str], labels: list[int], rounds: int = 60, ridge: float = 1.0) -> None:
        """Logistic regression by Newton's method."""
        x, y = self._expanded([self.difference(t) for t in texts]), np.array(labels, float)
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-9
        x = np.column_stack([np.ones(len(x)), (x - self.centre) / self.scale])
        w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
        penalty[0] = 1e-3
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
            step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), 0.5)
        x = (self._expanded([self.difference(t) for t in texts]) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def train(rows: list[tuple[int, str, int]]) -> QualityModel:
    """Dictionaries from two thirds of the labelled rows, calibration on the other third."""
    learn = [r for i, r in enumerate(rows) if i % 3]
    check = [r for i, r in enumerate(rows) if not i % 3]
    good, bad = ([t.encode() for _, t, y in learn if y == want and t] for want in (1, 0))
    if not good or not bad or len({y for _, _, y in check}) < 2:
        return QualityModel(b"", b"")
    model = QualityModel(_dictionary(good), _dictionary(bad))
    model.calibrate([t for _, t, _ in check], [y for _, _, y in check])
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    return train(sample(docs, labels, "quality", MODULUS, HELD, per_class, LONGEST).rows)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                scores = model.scores([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (remainder("doc_id", MODULUS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents with a score of the threshold or more, with the input's columns."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidy(lambda series: (pd.Series(model.scores([t or "" for t in texts])) for texts in series))(batches)

    return docs.filter(scores("text") >= THRESHOLD)
