from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

#: Rows that every operator on documents has to take.
EDGES = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "src1", "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "src1", "x"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "src1", "x"),
    (3, "THE quick Brown fox jumps over the lazy dog", None, None, None),
    (4, None, "en", "src2", "y"),
    (5, "", "de", "src2", "y"),
    (6, " \t\n ", "de", "src3", "y"),
    (7, "One", "fr", "src3", "y"),
    (None, "no id at all but five words", "fr", None, "y"),
    (None, None, None, None, None),
    (8, "é ñ ß 漢字 😀 " * 3000, "es", "src4", "y"),
    (9, "word" * 20000, "es", "src4", "y"),
    (10, "alpha beta gamma delta epsilon zeta " * 2500, "en", "src5", "z"),
]
#: Names that operators use inside, as further columns of the input.
EXTRA = ["score", "tokens", "digest", "key", "row", "content file", "licenses", "pii", "n", "hub", "copies", "whole"]


@pytest.fixture
def edges(spark) -> DataFrame:
    rows = [(*row, *(f"{name}{i}" for name in EXTRA)) for i, row in enumerate(EDGES)]
    schema = "doc_id long, text string, lang string, source string, note string, " + ", ".join(f"`{n}` string" for n in EXTRA)
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def nothing(edges) -> DataFrame:
    return edges.where("false")
