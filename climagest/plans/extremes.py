"""Counts of extreme days per pregnancy window, for heat and for cold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from climagest.operators.births import gestation_dates, prepare_births
from climagest.operators.counts import flag_days, window_counts
from climagest.operators.weather import prepare_weather
from climagest.schema import FLAGS, POSTCODE_BOUNDS, WINDOWS
from climagest.sources.ledger import Ledger
from climagest.sources.readers import read_births, read_weather
from climagest.sources.shared import written
from climagest.sources.writers import write_all_window_counts


def extreme_day_counts(
    births: DataFrame,
    weather: DataFrame,
    family: str = "Hot",
    windows: Sequence[str] = tuple(WINDOWS),
    bounds: tuple[int, int] | None = POSTCODE_BOUNDS,
    **options,
) -> DataFrame:
    """Raw births and flagged weather to the ten counts per birth and window."""
    flags = FLAGS[family]
    dated = gestation_dates(prepare_births(births, bounds))
    days = flag_days(prepare_weather(weather, None, flags, bounds), flags, **options)
    return window_counts(dated, days, windows)


def hot_window_counts(births: DataFrame, weather: DataFrame, **options) -> DataFrame:
    return extreme_day_counts(births, weather, "Hot", **options)


def cold_window_counts(births: DataFrame, weather: DataFrame, **options) -> DataFrame:
    return extreme_day_counts(births, weather, "Cold", **options)


def write_extreme_day_counts(
    spark: SparkSession,
    births_path: str,
    weather_path: str,
    folder: str,
    family: str = "Hot",
    format: str = "parquet",
    weather_format: str | None = None,
    ledger: Ledger | None = None,
) -> list[str]:
    """Read, count all windows in one go and write one CSV dataset per window.

    What cleaning dropped, by reason, is written beside them as ``<family>_ledger.csv`` and stays in ``ledger``.
    """
    flags, ledger = FLAGS[family], ledger or Ledger()
    # the raw births are read, cleaned and counted once
    births = written(prepare_births(read_births(spark, births_path, format), ledger=ledger), "births")
    dated = gestation_dates(births)
    weather = prepare_weather(read_weather(spark, weather_path, family, weather_format or format), None, flags)
    days = flag_days(weather, flags)
    paths = write_all_window_counts(window_counts(dated, days, ledger=ledger), folder, family, WINDOWS.values())
    ledger.write(spark, f"{folder.rstrip('/')}/{family}_ledger.csv")
    return paths
