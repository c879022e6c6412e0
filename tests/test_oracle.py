"""Every registered query against its SQL in DuckDB, and the ordered ones on the split way too."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import DATA, compare, connect
from gridlark.operators import ordered
from gridlark.plans import ordered_queries
from gridlark.plans.registry import QUERIES

FOLDER = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 25


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, duck, key):
    verdict, _ = compare(queries()[key](spark, FOLDER), duck, oracle_sql()[key])
    assert verdict == "ok"


@pytest.mark.parametrize("key", ordered_queries.QUERIES)
def test_split_way(spark, duck, key, monkeypatch):
    monkeypatch.setattr(ordered, "GROUP_ROWS", 40)
    verdict, _ = compare(queries()[key](spark, FOLDER), duck, oracle_sql()[key])
    assert verdict == "ok"
