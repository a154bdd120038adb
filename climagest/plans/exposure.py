"""Daily exposure of each birth, and its means within percentile bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from climagest.operators.bands import band_means, exposure_blocks, percentile_dataset, prepared_bands
from climagest.operators.births import exposure_births, longest_span, prepare_births
from climagest.operators.filters import open_range
from climagest.operators.numbering import number_rows
from climagest.operators.spine import day_exposure
from climagest.operators.weather import location_percentiles, prepare_weather
from climagest.operators.wide import exposure_wide
from climagest.schema import POSTCODE_BOUNDS
from climagest.sources.readers import read_births, read_weather
from climagest.sources.shared import written
from climagest.sources.writers import write_by_location, write_table


def exposure_long(
    births: DataFrame,
    weather: DataFrame,
    exposure_col: str = "TAVG",
    bounds: tuple[int, int] | None = POSTCODE_BOUNDS,
) -> DataFrame:
    """Raw births and weather to one row per birth and day with its exposure.

    ``birth_row`` numbers the births of a postcode from 1.
    """
    cohort = exposure_births(prepare_births(births, bounds))
    numbered = number_rows(cohort, ["RFA_ID", "admd", "pre"], within=["location"], name="birth_row")
    blocks = exposure_blocks(prepare_weather(weather, exposure_col, bounds=bounds))
    return day_exposure(numbered, blocks).select(
        "location", "birth_row", "RFA_ID", "admd", "pre", "tr3_end", "day_idx", "date", "exposure"
    )


def write_exposure_wide(
    spark: SparkSession, births_path: str, weather_path: str, output: str, exposure_col: str = "TAVG"
) -> None:
    """The wide exposure table, with as many Day_ columns as the longest birth needs; none for an empty cohort."""
    cohort = exposure_births(prepare_births(read_births(spark, births_path)))
    blocks = exposure_blocks(prepare_weather(read_weather(spark, weather_path, exposure_col=exposure_col), exposure_col))
    n_days = longest_span(cohort).first()["max_days"] or 0
    write_table(exposure_wide(cohort, blocks, n_days), output)


def write_percentile_dataset(
    spark: SparkSession, births_path: str, weather_path: str, output: str, exposure_col: str = "TAVG"
) -> None:
    """Wide exposures with percentiles, one directory per postcode."""
    raw = read_weather(spark, weather_path, exposure_col=exposure_col)
    weather = written(prepare_weather(raw, exposure_col, bounds=None), "weather")
    cohort = exposure_births(prepare_births(read_births(spark, births_path)))
    blocks = exposure_blocks(open_range(weather, "location", POSTCODE_BOUNDS))
    percentiles = written(location_percentiles(weather), "percentiles")
    n_days = longest_span(cohort).first()["max_days"] or 0
    write_by_location(percentile_dataset(cohort, blocks, percentiles, n_days), output, laid=blocks.fits)


def write_band_means(
    spark: SparkSession,
    births_path: str,
    weather_path: str,
    output: str,
    first: int = 1,
    last: int = 91,
    exposure_col: str = "TAVG",
) -> None:
    """Band means over a range of days, one directory per postcode."""
    raw = read_weather(spark, weather_path, exposure_col=exposure_col)
    cohort = exposure_births(prepare_births(read_births(spark, births_path)))
    bands = prepared_bands(prepare_weather(raw, exposure_col, bounds=None), bounds=POSTCODE_BOUNDS)
    write_by_location(band_means(cohort, bands, first, last), output)
