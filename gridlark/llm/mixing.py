"""Mix sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated as often as the cap allows.
A document's virtual finish time is the number of its source's words up to and with it, divided by
the source's target. Documents of all sources are ordered by finish time and the order is cut where
the words reach the budget, so that every source comes near its target at the cut.

No running sum goes through one task: shuffle keys cut a source into buckets, finish times cut the
order into buckets, and only one row per bucket is summed in order.

Defined results: a null text has no words; a null source is a source, the last one; documents
without words are never taken; rows alike in all columns are rows of their own; an empty table gives
an empty result; columns of the input are kept under their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.functions.values import quoted
from gridlark.llm.names import fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
# Buckets of a source's shuffled order, and of finish times up to 1. A bucket is what one task sorts.
BUCKET_BITS = 12


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str, size: str, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: rank, source_size and target, from rows of partial sizes.

    The budget is shared by weight; what a source may not take, being above ``cap`` times its size,
    is shared anew by weight among the others, until none is above. Sorted by cap over weight the
    capped sources come first, so one pass of running sums finds them.
    """
    totals = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col(source).asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    )
    before = everything.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(
        Window.unboundedPreceding, -1
    )
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    capped = (
        ranked.withColumn("most", cap * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("level", (F.col("total") - gone("most")) / (F.col("weights") - gone("weight")))
        .withColumn("capped", F.col("level") > F.col("most") / F.col("weight"))
    )
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    spent = F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(everything), F.lit(0))
    return capped.withColumn(
        "target",
        F.when(F.col("capped"), F.col("most").cast("double")).otherwise(
            F.col("weight") * ((F.col("total") - spent) / open_weight)
        ),
    ).select(source, "rank", "source_size", "total", "target")


def mix(
    docs: DataFrame,
    into: str = "mix",
    weights: Sequence[int] = WEIGHTS,
    cap: int = 3,
    seed: str = SEED,
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """The input's rows and a struct ``into``: size, source_size, target, copies.

    ``copies`` says how often the mix takes the document, 0 to ``cap``. The budget is the size of all
    documents. A copy is queued only while its source is below its target, so a source goes over by
    less than one document.
    """
    # The input's columns bear numbers meanwhile, so that no name of theirs can clash.
    size, source, key, bucket, upto, copies = "size", "queue", "key", "bucket", "upto", "copies"
    numbered = [F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(docs.columns)]
    name = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.select(
        *numbered, "doc_id", words_of(F.col("text")).alias(size), F.col("source").alias(source), name.alias(key)
    ).withColumn(bucket, F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % (1 << bits))
    rows = rows.repartition(source, bucket)
    parts = rows.groupBy(source, bucket).agg(F.sum(size).alias("words"))
    earlier = Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col(source).alias("s"),
        F.col(bucket).alias("b"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"),
    )
    targets = source_targets(parts, source, "words", weights, cap).withColumnRenamed(source, "t")
    inside = Window.partitionBy(source, bucket).orderBy(key, "doc_id", size)
    queued = (
        rows.withColumn(upto, F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, F.col(source).eqNullSafe(F.col("s")) & (F.col(bucket) == F.col("b")), "left")
        .join(targets, F.col(source).eqNullSafe(F.col("t")), "left")
        .withColumn(upto, F.col(upto) + F.col("base"))
    )

    def copy(e: Column) -> Column:
        """Copy number ``e`` in the order of finish times; null once the source has its target."""
        done = e * F.col("source_size") + F.col(upto)
        return F.when(
            (F.col("target") > 0) & (F.col(size) > 0) & (done - F.col(size) < F.col("target")),
            F.struct(
                (done / F.col("target")).alias("finish"), F.col("rank"), F.col(key).alias("key"),
                F.col("doc_id").alias("id"), e.alias("copy"),
            ),
        )

    queued = queued.withColumn(
        copies,
        F.filter(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), copy), lambda c: c.isNotNull()),
    )
    order = queued.select(F.col(size).alias("words"), "total", F.explode(copies).alias("c")).withColumn(
        "slot", F.least(F.floor(F.col("c.finish") * (1 << bits)), F.lit(2 << bits))
    )
    slots = order.groupBy("slot").agg(F.sum("words").alias("words"), F.max("total").alias("total"))
    over = slots.withColumn("upto", F.sum("words").over(Window.partitionBy(F.lit(0)).orderBy("slot")))
    crossing = over.filter(F.col("upto") > F.col("total")).agg(
        F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("base"))).alias("x")
    )
    # The first copy that is left out; none is if all copies together keep the budget.
    within = (
        order.join(crossing.select("x.*").withColumnRenamed("slot", "at"), F.col("slot") == F.col("at"))
        .withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("slot").orderBy("c")))
        .filter(F.col("upto") > F.col("total"))
        .agg(F.min("c").alias("cut"))
    )
    cut = within.scalar()
    taken = F.filter(copies, lambda c: F.col("first_out").isNull() | (c < F.col("first_out")))
    return queued.withColumn("first_out", cut).select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.struct(
            F.col(size).alias("size"),
            F.col("source_size"),
            F.col("target"),
            F.size(taken).alias("copies"),
        ).alias(into),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the input's columns."""
    (into, again) = fresh(docs.columns, "mix", "again")
    mixed = mix(docs, into, **options).filter(F.col(f"{into}.copies") > 0)
    return mixed.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(f"{into}.copies")))).select(
        *map(quoted, docs.columns)
    )
