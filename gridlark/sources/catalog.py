"""Reading the catalog tree of a session into an inventory."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from gridlark.functions.values import quoted

log = logging.getLogger(__name__)

INVENTORY = "catalog STRING, namespace STRING, name STRING, type STRING, is_temporary BOOLEAN"


def _shown(spark: SparkSession, statement: str) -> list | None:
    """Rows of one SHOW command, or ``None`` when the catalog refuses it."""
    try:
        return spark.sql(statement).collect()
    except Exception:
        log.debug("skipped: %s", statement, exc_info=True)
        return None


def load_inventory(spark: SparkSession) -> DataFrame:
    """Catalogs, their first-level namespaces, tables and views.

    SHOW commands run at the driver whatever calls them, so this is the one place that walks the
    tree; everything else works on the DataFrame that it returns. What cannot be listed is left
    out, the rest is kept. Save the result as a table where the tree is large.
    """
    rows = []
    for (catalog,) in _shown(spark, "SHOW CATALOGS") or []:
        namespaces = _shown(spark, f"SHOW NAMESPACES IN {quoted(catalog)}") or []
        if not namespaces:
            rows.append((catalog, None, None, None, False))
        for (namespace,) in namespaces:
            rows.extend(_items(spark, catalog, namespace))
    return spark.createDataFrame(rows, INVENTORY)


def _items(spark: SparkSession, catalog: str, namespace: str) -> list[tuple]:
    place = f"{quoted(catalog)}.{namespace}"
    tables = _shown(spark, f"SHOW TABLES IN {place}") or []
    views = _shown(spark, f"SHOW VIEWS IN {place}") or []
    rows = [(catalog, namespace, r.tableName, "table", r.isTemporary) for r in tables]
    rows += [(catalog, namespace, r.viewName, "view", r.isTemporary) for r in views]
    return rows or [(catalog, namespace, None, None, False)]
