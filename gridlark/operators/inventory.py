"""Catalog inventory as a table: one row per item, listed and searched with DataFrames.

An inventory has the columns ``catalog, namespace, name, type, is_temporary``. A catalog without
namespaces, or a namespace without items, is a row whose lower levels are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.functions.text import valid_identifier


def permanent(inv: DataFrame) -> DataFrame:
    """Without temporary views, which Spark shows in every namespace."""
    return inv.where(~F.coalesce(F.col("is_temporary"), F.lit(False)))


def list_catalogs(inv: DataFrame) -> DataFrame:
    return inv.select("catalog").distinct()


def list_namespaces(inv: DataFrame, catalog: str) -> DataFrame:
    found = inv.where((F.col("catalog") == catalog) & F.col("namespace").isNotNull())
    return found.select("namespace").distinct()


def _typed_items(inv: DataFrame) -> DataFrame:
    """One row per item; a name seen as table and as view is a view."""
    is_view = F.max(F.when(F.col("type") == "view", 1).otherwise(0))
    return (
        permanent(inv)
        .where(F.col("name").isNotNull())
        .groupBy("catalog", "namespace", "name")
        .agg(F.when(is_view == 1, "view").otherwise("table").alias("type"))
    )


def list_items(inv: DataFrame, catalog: str, namespace: str) -> DataFrame:
    found = inv.where((F.col("catalog") == catalog) & (F.col("namespace") == namespace))
    return _typed_items(found).select("name", "type")


def search(inv: DataFrame, text: str) -> DataFrame:
    """Hits of a case-insensitive literal substring among catalogs, namespaces and items.

    One pass: each inventory row gives up to three candidates, the text filters them before the
    one aggregation that makes hits unique and settles table against view.
    """
    none = F.lit(None).cast("string")

    def level(kind, catalog, namespace, table, name):
        return F.struct(
            kind.alias("kind"),
            catalog.alias("catalog"),
            namespace.alias("namespace"),
            table.alias("table"),
            name.alias("name"),
        )

    catalog, namespace, name = F.col("catalog"), F.col("namespace"), F.col("name")
    is_view = F.when(F.col("type") == "view", 3).otherwise(2)
    levels = F.array(
        level(F.lit(0), catalog, none, none, catalog),
        level(F.lit(1), catalog, namespace, none, namespace),
        level(is_view, catalog, namespace, name, name),
    )
    hits = (
        permanent(inv)
        .select(F.explode(levels).alias("hit"))
        .select("hit.*")
        .where(F.contains(F.lower("name"), F.lower(F.lit(text))))
    )
    kind = F.max("kind")
    return (
        hits.groupBy("catalog", "namespace", "table", "name")
        .agg(
            F.when(kind == 0, "catalog")
            .when(kind == 1, "namespace")
            .when(kind == 2, "table")
            .otherwise("view")
            .alias("type")
        )
        .select("type", "catalog", "namespace", "table", "name")
    )


def safe_names(df: DataFrame, column: str) -> DataFrame:
    """Each name with the verdict whether it may stand in a statement."""
    return df.select(F.col(column).alias("name"), valid_identifier(F.col(column)).alias("valid"))
