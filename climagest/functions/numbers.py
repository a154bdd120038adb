"""Lenient numeric casts and missing-value rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plain decimal numbers, optionally signed. Java's parser would also take suffixes
# such as "29001d", which are not numbers here.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE_PATTERN = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"


def _matching(column: Column | str, pattern: str) -> Column:
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.rlike(pattern), text)


def to_number(column: Column | str) -> Column:
    """Number held by ``column`` as a double; malformed text becomes null."""
    return _matching(column, NUMBER_PATTERN).try_cast("double")


def to_whole(column: Column | str) -> Column:
    """Whole number held by ``column`` as an int; anything else becomes null."""
    return _matching(column, WHOLE_PATTERN).try_cast("double").try_cast("int")


def drop_nan(column: Column | str) -> Column:
    """NaN counts as missing. Spark would sort it above every number instead."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(value), value)


def number_column(df: DataFrame, name: str) -> Column:
    """``to_number``, without going through text where the column holds numbers."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return drop_nan(name)
    return to_number(name)


def whole_column(df: DataFrame, name: str) -> Column:
    """``to_whole``, without going through text where the column holds numbers."""
    stored = df.schema[name].dataType
    if isinstance(stored, (T.ByteType, T.ShortType, T.IntegerType)):
        return F.col(name)
    if isinstance(stored, T.NumericType):
        value = F.col(name).cast("double")
        return F.when(value == F.floor(value), value).try_cast("int")
    return to_whole(name)
