"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from compare import database, differences

FOLDER = entry_points.SMALLEST
QUERIES = entry_points.QUERIES
ORACLE = entry_points.ORACLE


@pytest.fixture(scope="module")
def tables():
    return database(FOLDER)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, tables, name):
    result = QUERIES[name](spark, FOLDER).toArrow()
    assert differences(result, tables.execute(ORACLE[name]).to_arrow_table()) == []
