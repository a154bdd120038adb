"""Choosing and naming columns of a wide table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_PREFIX = "Day_"


def day_names(first: int, last: int) -> list[str]:
    """Generated names of the day columns ``first`` .. ``last``."""
    return [f"{DAY_PREFIX}{k}" for k in range(first, last + 1)]


def named_like(df: DataFrame, prefix: str) -> list[str]:
    return [name for name in df.columns if name.startswith(prefix)]


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [name for name in df.columns if re.search(pattern, name)]


def containing(df: DataFrame, fragment: str) -> list[str]:
    """Columns whose name holds ``fragment``, letter case ignored."""
    return [name for name in df.columns if fragment.lower() in name.lower()]


def between_columns(df: DataFrame, first: str, last: str) -> list[str]:
    """The run of columns from ``first`` to ``last`` in table order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def move_after(df: DataFrame, names: Sequence[str], anchor: str) -> DataFrame:
    """Place ``names`` right behind ``anchor``; other columns keep their order."""
    rest = [name for name in df.columns if name not in names]
    cut = rest.index(anchor) + 1
    return df.select(*rest[:cut], *names, *rest[cut:])


def pad_with_nulls(array: Column, length: Column | int, element_type: str) -> Column:
    """Lengthen ``array`` with nulls; an array already long enough is left alone."""
    wanted = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(wanted - F.size(array), F.lit(0))
    return F.concat(array, F.array_repeat(F.lit(None).cast(element_type), missing))
