"""Corpus queries that SQL can express, against that SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from climagest.llm.oracle import ORACLE
from climagest.llm.queries import QUERIES
from compare import database, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return database(FOLDER)


@pytest.mark.parametrize("name", ORACLE)
def test_same_rows(spark, tables, name):
    assert differences(QUERIES[name](spark, FOLDER).toArrow(), tables.execute(ORACLE[name]).to_arrow_table()) == []
