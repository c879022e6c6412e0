"""All registered queries."""

from __future__ import annotations

from gridlark.plans import (
    inspect_queries,
    inventory_queries,
    joblog_queries,
    load_queries,
    ordered_queries,
    recursive_queries,
    result_queries,
    sqlset,
)
from gridlark.plans.query import Query

QUERIES: dict[str, Query] = {
    **sqlset.QUERIES,
    **ordered_queries.QUERIES,
    **recursive_queries.QUERIES,
    **result_queries.QUERIES,
    **inventory_queries.QUERIES,
    **inspect_queries.QUERIES,
    **joblog_queries.QUERIES,
    **load_queries.QUERIES,
}
