"""Parquet and CSV outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climagest.schema import Window
from climagest.sources.readers import ZIP_PART
from climagest.sources.shared import fresh_path


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_by_location(df: DataFrame, path: str, location: str = "location", laid: bool = False) -> None:
    """One directory per postcode.

    The rebalance hint gathers each postcode's rows in few files and lets
    adaptive execution split a postcode too large for one task. With ``laid``, rows
    come cut and sorted by postcode and are written as they come, without being moved.
    """
    rows = df.withColumn(ZIP_PART, F.col(location))
    (rows if laid else rows.hint("rebalance", ZIP_PART)).write.mode("overwrite").partitionBy(ZIP_PART).parquet(path)


def _in_order(df: DataFrame, sort_by: tuple[str, ...]) -> DataFrame:
    """Rows sorted across tasks. Equal keys are told apart by their place in the input, so a key that
    most rows have is cut over several tasks as well."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    return tied.repartitionByRange(*sort_by, "_tie").sortWithinPartitions(*sort_by, "_tie").drop("_tie")


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), sort_by: tuple[str, ...] = ()) -> None:
    """CSV with a header, optionally split by column and sorted."""
    rows = _in_order(df, sort_by) if sort_by else df
    rows.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def write_window_counts(counts: DataFrame, folder: str, family: str, window: Window) -> str:
    """CSV dataset of one window, with the window's own name for its start, sorted by postcode."""
    path = f"{folder.rstrip('/')}/{window.file_label}_{family}.csv"
    rows = counts.where(F.col("window") == window.name).drop("window")
    write_csv(rows.withColumnRenamed("start", window.start_label), path, sort_by=("ZIP", "RFA_ID", "ADMD"))
    return path


def write_all_window_counts(counts: DataFrame, folder: str, family: str, windows: Iterable[Window]) -> list[str]:
    """One CSV dataset per window. The counts are worked out and stored once, divided by window, and each
    dataset is written from its own part."""
    stored = fresh_path(counts.sparkSession, "window-counts")
    counts.write.partitionBy("window").parquet(stored)
    parts = counts.sparkSession.read.schema(counts.schema).parquet(stored)
    return [write_window_counts(parts, folder, family, window) for window in windows]


def write_counts_by_window(counts: DataFrame, path: str) -> str:
    """All windows in one CSV dataset, one directory per window, sorted by postcode in each."""
    write_csv(counts, path, partition_by=("window",), sort_by=("window", "ZIP", "RFA_ID", "ADMD"))
    return path
