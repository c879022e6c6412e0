"""A bounded sample of labelled documents for training on the driver.

The sample is drawn over all labels by a hash of doc_id, so it is the same in every run and of the
same size at every input size. Only the sampled ids, whose number is bounded, are sent to the tasks
that look for their texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


@dataclass(frozen=True)
class Sample:
    """Rows of doc_id, text, label, and how many labels of each class there are in all."""

    rows: list[tuple[int, str, int]]
    zeros: int
    ones: int


def sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, longest: int
) -> Sample:
    """Up to ``per_class`` documents of each class, none of the held-out remainder.

    Texts of more than ``longest`` characters, rows without text and labels other than 0 and 1 are no
    samples. Of several labels of a document the smallest holds.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(remainder("doc_id", modulus) != held)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"))
    )
    pick = lambda y: known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).unionByName(pick(1))
    texts = docs.select(F.col("doc_id"), "text").filter(F.length("text") <= longest)
    found = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toPandas()
    found = found.drop_duplicates().sort_values(["doc_id", "text"])
    number = {row["label"]: row["count"] for row in known.groupBy("label").count().collect()}
    return Sample(list(found.itertuples(index=False, name=None)), number.get(0, 0), number.get(1, 0))
