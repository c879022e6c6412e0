"""Find benchmark passages in documents through a positional inverted index, in SQL functions only.

1. Benchmark items become phrases: every run of ten words, or a shorter item as a whole.
2. The documents' words are stored once, as a table in the cluster's shared folder. A pass over it
   counts the terms of the phrases; a phrase's terms are ranked from the rarest on.
3. A second pass stores the postings of the rarest terms: document, position and the few words around
   it.
4. The lists of a phrase's terms, moved by the term's offset, are intersected from the rarest on; the
   words around the rarest term decide whether the whole phrase stands there.

The terms and phrases of the benchmark are broadcast if their counted number is small, and joined by
shuffle otherwise. Documents are never joined with each other, nor shuffled as texts.

Defined results: words are lower-cased in A-Z only; a null or wordless document has no words and no
hits; a null or wordless item, or one without an id, takes no part; equal windows of several items
count for each; rows alike in doc_id and text get the same numbers each; rows with one doc_id but
different texts are documents of their own; an empty benchmark leaves all documents clean; other
columns of the input do not matter.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlark.sources.scratch import scratch_path

# Word characters after lower-casing: all but 00-2F, 3A-60 and 7B-7F. The regex engine is many times
# faster with this class than with the negated one.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
WIDTH = 10
# Terms of a phrase whose lists are intersected before the words around the rarest one are compared.
LISTS = 2
# Rows of terms or phrases that may be sent to every task; at up to 500 bytes each, 25 MB.
MOST_SENT = 50_000


def words_of(text: Column) -> Column:
    """Words, lower-cased in A-Z; an empty array for null."""
    low = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), 0), F.array().cast("array<string>"))


def store_words(docs: DataFrame, path: str) -> DataFrame:
    """Write and return doc_id, text_hash, n_words, words; the first two name a document."""
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words"))
    words.withColumn("n_words", F.size("words").cast("long")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def phrases(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct rows of item_id, words, n: every window of the item."""
    whole = items.filter(F.col("item_id").isNotNull()).select("item_id", words_of(F.col("text")).alias("w"))
    whole = whole.filter(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    cut = whole.select("item_id", "n", "w", F.explode(starts).alias("s"))
    return cut.select("item_id", F.slice("w", F.col("s"), F.col("n")).alias("words"), "n").distinct()


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """The small side of a join: sent to all tasks if its counted rows allow it."""
    return F.broadcast(df) if rows <= MOST_SENT else df


def _places(words: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """Places of the given terms: document, position, term, and the document's words."""
    places = words.select("doc_id", "text_hash", "words", F.posexplode("words").alias("pos", "term"))
    return places.join(_sent(terms.select("term"), rows), "term")


def ranked_phrases(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct phrases with their terms as (places in the corpus, offset, term), rarest first."""
    terms = windows.select(F.explode("words").alias("term")).distinct()
    places = _places(words, terms, terms.count()).groupBy("term").agg(F.count(F.lit(1)).alias("places"))
    distinct = windows.select("words", "n").distinct()
    offsets = distinct.select("words", "n", F.posexplode("words").alias("offset", "term"))
    return (
        offsets.join(places, "term", "left")
        .groupBy("words", "n")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.coalesce("places", F.lit(0)).alias("places"), "offset", "term"))
            ).alias("terms")
        )
    )


def build_index(words: DataFrame, terms: DataFrame, path: str, reach: int = WIDTH - 1) -> DataFrame:
    """Write the postings of ``terms`` and return them: term, document, pos, from, around.

    ``around`` holds the words from position ``from`` on, up to ``reach`` on either side of the term.
    """
    places = _places(words, terms, terms.count())
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("words", start + 1, F.col("pos") - start + 1 + reach)
    places.select(
        "term", "doc_id", "text_hash", "pos", start.alias("from"), around.alias("around")
    ).write.parquet(path)
    return words.sparkSession.read.parquet(path)


def _same(a: str, b: str, *columns: str) -> Column:
    """Join condition over columns that may be null."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return condition


def phrase_matches(postings: DataFrame, ranked: DataFrame, lists: int = LISTS) -> DataFrame:
    """Places of whole phrases: doc_id, text_hash, start, n, words.

    Lists are intersected from the rarest term on; the rest of the phrase is read around that term.
    """
    rows = ranked.count()
    first = F.col("terms")[0]
    found = (
        postings.alias("p")
        .join(_sent(ranked.withColumn("rarest", first["term"]), rows), F.col("p.term") == F.col("rarest"))
        .withColumn("start", F.col("pos") - first["offset"])
        .filter(F.col("start") >= F.col("from"))
    )
    for i in range(1, lists):
        other = F.get("terms", F.lit(i))
        wanted = found.withColumn("next", other["term"]).withColumn("at", F.col("start") + other["offset"])
        # A phrase of fewer terms has no further list to meet.
        there = postings.select("term", "doc_id", "text_hash", "pos").alias("q")
        met = wanted.alias("f").join(
            there,
            _same("f", "q", "doc_id", "text_hash")
            & (F.col("next") == F.col("q.term"))
            & (F.col("at") == F.col("q.pos")),
            "left_semi",
        )
        found = met.unionByName(wanted.filter(F.col("next").isNull())).drop("next", "at")
    here = F.slice("around", F.col("start") - F.col("from") + 1, F.col("n"))
    return found.filter(here == F.col("words")).select("doc_id", "text_hash", "start", "n", "words")


def proximity_matches(postings: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """Documents where a phrase's two rarest terms stand at most ``slop`` words off their places.

    Rows of doc_id, text_hash, words, moved: the smallest shift. A phrase of one term is met by it.
    """
    rows = ranked.count()
    a, b = F.col("terms")[0], F.get("terms", F.lit(1))
    first = postings.select("term", "doc_id", "text_hash", F.col("pos").alias("start")).join(
        _sent(ranked.withColumn("rarest", a["term"]).withColumn("next", b["term"]), rows),
        F.col("term") == F.col("rarest"),
    )
    first = first.withColumn("at", F.col("start") - a["offset"] + b["offset"]).alias("f")
    there = postings.select("term", "doc_id", "text_hash", "pos").alias("q")
    # Positions are joined by blocks of slop + 1, so that a document's lists are not paired whole.
    block = slop + 1
    near = first.withColumn("block", F.explode(F.array(*[F.floor(F.col("at") / block) + i for i in (-1, 0, 1)])))
    pairs = near.alias("f").join(
        there.withColumn("block", F.floor(F.col("pos") / block)).alias("q"),
        _same("f", "q", "doc_id", "text_hash", "block") & (F.col("next") == F.col("q.term")),
    )
    pairs = pairs.withColumn("moved", F.abs(F.col("q.pos") - F.col("at"))).filter(F.col("moved") <= slop)
    single = first.filter(F.col("next").isNull()).select(
        "f.doc_id", "f.text_hash", "words", F.lit(0).alias("moved")
    )
    return (
        pairs.select("f.doc_id", "f.text_hash", "words", "moved")
        .unionByName(single)
        .groupBy("doc_id", "text_hash", "words")
        .agg(F.min("moved").alias("moved"))
    )


def index_for(docs: DataFrame, items: DataFrame, width: int = WIDTH, lists: int = LISTS):
    """The stored words, the items' windows, ranked phrases and postings of their rarest terms."""
    spark = docs.sparkSession
    base = scratch_path(spark, "positions")
    words = store_words(docs, f"{base}/words")
    windows = phrases(items, width)
    ranked_phrases(words, windows).write.parquet(f"{base}/phrases")
    ranked = spark.read.parquet(f"{base}/phrases")
    rare = ranked.select(F.explode(F.slice("terms", 1, lists)).alias("t")).select("t.term").distinct()
    return words, windows, ranked, build_index(words, rare, f"{base}/postings", width - 1)


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The stored words, and the documents with hits: doc_id, text_hash, n_hit, items.

    ``items`` holds the ids as texts, in order.
    """
    words, windows, ranked, postings = index_for(docs, items, width)
    found = phrase_matches(postings, ranked).distinct()
    spans = found.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans")
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("words"), F.lit(0).alias("end")),
        lambda seen, s: F.struct(
            (seen["words"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], seen["end"]))).alias("words"),
            F.greatest(seen["end"], s["end"]).alias("end"),
        ),
        lambda seen: seen["words"].cast("long"),
    )
    members = found.select("doc_id", "text_hash", "words").distinct().join(windows.select("item_id", "words"), "words")
    listed = members.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    hits = (
        spans.select("doc_id", "text_hash", covered.alias("n_hit"))
        .alias("s")
        .join(listed.alias("l"), _same("s", "l", "doc_id", "text_hash"))
        .select("s.doc_id", "s.text_hash", "n_hit", "items")
    )
    return words, hits


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    words, hits = contaminated(docs, items, width)
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    sizes = words.select("doc_id", "text_hash", "n_words").alias("d")
    return sizes.join(hits.alias("h"), _same("d", "h", "doc_id", "text_hash"), "left").select(
        "d.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any benchmark passage, with the input's columns."""
    _, hits = contaminated(docs, items, width)
    return docs.alias("d").join(
        hits.alias("h"),
        F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.xxhash64("d.text") == F.col("h.text_hash")),
        "left_anti",
    )
