"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from climagest.functions.columns import containing
from climagest.sources.shared import small


def open_range(df: DataFrame, column: str, bounds: tuple[int, int]) -> DataFrame:
    low, high = bounds
    return df.where((F.col(column) > low) & (F.col(column) < high))


def pruned(df: DataFrame, column: str, bounds: tuple[int, int] | None) -> DataFrame:
    """``open_range`` on a column as it is stored, if it holds numbers; only such a filter reaches the file reader."""
    if bounds and isinstance(df.schema[column].dataType, NumericType):
        return open_range(df, column, bounds)
    return df


def flagged_days(weather: DataFrame, flag: str) -> DataFrame:
    """Days of each postcode on which ``flag`` is set."""
    return weather.where(F.col(flag) == 1).select("date", flag, "location")


def any_column_in(df: DataFrame, fragment: str, allowed: DataFrame) -> DataFrame:
    """Rows where at least one column whose name holds ``fragment`` has an allowed value.

    ``allowed`` has one column. Each matching column gets its own equality join,
    as a single join on the alternatives would compare every pair of rows.
    """
    value = allowed.columns[0]
    known = small(allowed.select(F.col(value).alias("_allowed")).where("_allowed IS NOT NULL").distinct())
    names = containing(df, fragment)
    if len(names) == 1:
        return df.join(known, F.col(names[0]) == F.col("_allowed"), "left_semi")
    marked, hits = df, []
    for position, name in enumerate(names):
        hit = f"_hit_{position}"
        side = known.select(F.col("_allowed").alias(hit))
        marked = marked.join(side, F.col(name) == F.col(hit), "left")
        hits.append(F.col(hit))
    return marked.where(F.coalesce(*hits).isNotNull()).select(*df.columns)
