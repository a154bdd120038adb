"""Exposure windows of pregnancies on Spark: days, percentile bands and counts of extremes."""

from climagest.operators.bands import (
    band_means,
    band_means_of_days,
    exposure_blocks,
    fold_bands,
    percentile_dataset,
    prepared_bands,
    thresholds,
)
from climagest.operators.births import exposure_births, gestation_dates, longest_span, prepare_births
from climagest.operators.cohort import window_cohort
from climagest.operators.counts import flag_days, window_counts, window_counts_by_join
from climagest.operators.filters import any_column_in, flagged_days, open_range
from climagest.operators.numbering import number_rows, number_values, run_ids
from climagest.operators.spine import attach_exposure, day_exposure, day_spine, padded_dates
from climagest.operators.weather import (
    births_with_weather,
    daily_exposure,
    daily_flag_counts,
    location_frequency,
    location_percentiles,
    prepare_weather,
)
from climagest.operators.wide import (
    exposure_wide,
    map_groups,
    nest,
    pivot_days,
    split_groups,
    stack_tables,
    unnest,
    unpivot_days,
)
from climagest.plans.exposure import (
    exposure_long,
    write_band_means,
    write_exposure_wide,
    write_percentile_dataset,
)
from climagest.plans.extremes import (
    cold_window_counts,
    extreme_day_counts,
    hot_window_counts,
    write_extreme_day_counts,
)
from climagest.schema import COLD_FLAGS, HEAT_FLAGS, WINDOWS
from climagest.sources.readers import list_locations, read_births, read_location, read_weather
from climagest.sources.writers import write_by_location, write_csv, write_table, write_window_counts

__all__ = [name for name in dir() if not name.startswith("_")]
