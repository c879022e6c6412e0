"""Small document tables for the tests of gridlark.llm."""

from __future__ import annotations

from compare import DATA

FOLDER = str(DATA / "sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=0, source="s"):
    """A documents table: ids from ``start`` on, in order."""
    rows = [(start + i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs, *names):
    """The same table with columns that bear the operators' own names."""
    for name in names:
        docs = docs.selectExpr("*", f"'x' AS {name}")
    return docs
