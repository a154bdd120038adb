"""Mean exposure of each birth within percentile bands, over a range of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climagest.operators.blocks import (
    Blocks,
    exposure_on,
    fold_exposure,
    fold_running_totals,
    totals_between,
)
from climagest.operators.filters import open_range
from climagest.operators.numbering import number_rows
from climagest.operators.spine import BIRTH_ORDER
from climagest.operators.weather import daily_exposure, location_percentiles
from climagest.operators.wide import WIDE_KEYS, exposure_wide
from climagest.schema import PERCENTILES
from climagest.sources.shared import small, spread, written

DATASET_ORDER = ("location", "RFA_ID", "admd", "pre")

# Outer bands are open and become null as soon as one day of the range is
# missing. Inner bands are closed on both sides, so that a value on an edge
# counts in both neighbours, and they ignore missing days.
OUTER_BANDS = ("mean_below_5th", "mean_above_95th")
# Counts of infinite values share a total: positive ones count 1, negative ones this much.
NEGATIVE = 1 << 26
BANDS = {
    "mean_below_5th": "exposure < percentile_05",
    "mean_5th_to_10th": "exposure >= percentile_05 AND exposure <= percentile_10",
    "mean_10th_to_90th": "exposure >= percentile_10 AND exposure <= percentile_90",
    "mean_90th_to_95th": "exposure >= percentile_90 AND exposure <= percentile_95",
    "mean_above_95th": "exposure > percentile_95",
}


def percentile_dataset(
    births: DataFrame, blocks: Blocks, percentiles: DataFrame, n_days: int
) -> DataFrame:
    """Wide exposures of births that have one on their first day, with the
    percentiles of their postcode and a running Identifier.

    Births are numbered, and laid out by postcode and first day over as many tasks as their days need, while they are
    narrow; the days are added afterwards. If the blocks fit a broadcast the rows stay in that order.
    """
    begun = exposure_on(births.where("RFA_ID IS NOT NULL"), blocks, "pre", "_day_1").where("_day_1 IS NOT NULL")
    numbered = number_rows(begun.drop("_day_1"), DATASET_ORDER, name="Identifier")
    keep = ["location", *PERCENTILES, *(c for c in WIDE_KEYS if c != "location"), "Identifier"]
    rows = numbered.join(small(percentiles), "location")
    if blocks.fits:
        rows = spread(rows, n_days, (*BIRTH_ORDER, "Identifier"))
    wide = exposure_wide(rows, blocks, n_days, keep=keep, dealt=True)
    return wide.select(*(c for c in wide.columns if c != "Identifier"), "Identifier")


def thresholds(dataset: DataFrame) -> DataFrame:
    """The distinct percentile rows of a percentile dataset."""
    return dataset.select("location", *PERCENTILES).distinct()


def fold_bands(
    weather: DataFrame, percentiles: DataFrame, broadcast_bytes: int | None = None
) -> Blocks:
    """Running sums and counts per band over the days of each postcode.

    ``weather``: location, date, exposure. The difference of two running sums of
    doubles would carry the rounding of the whole history. Each value is therefore
    cut in two: a multiple of a power of two ("unit") coarse enough that sums of
    such multiples are exact, and a tiny rest. Infinite values stay out of the sums and are
    counted by band, so that they touch only the ranges that hold one.
    """
    days = written(daily_exposure(weather).where("exposure IS NOT NULL"), "daily")
    finite = F.abs("exposure") < float("inf")
    largest_sum = F.max(F.when(finite, F.abs("exposure"))) * F.count("*")
    scale = days.groupBy("location").agg(F.ceil(F.log2(F.greatest(largest_sum, F.lit(1e-300)))).alias("_power"))
    per_location = small(percentiles.join(scale, "location"))
    daily = written(
        days.join(per_location, "location")
        .withColumn("_unit", F.pow(F.lit(2.0), F.col("_power") - 52))
        .withColumn("_coarse", F.when(finite, F.rint(F.col("exposure") / F.col("_unit")) * F.col("_unit")))
        .select(
            "location",
            "date",
            "exposure",
            "_coarse",
            (F.col("exposure") - F.col("_coarse")).alias("_rest"),
            *(F.expr(band).alias(f"_in_{name}") for name, band in BANDS.items()),
        ),
        "band-days",
    )
    totals = {"days": F.when(F.col("exposure").isNotNull(), 1)}
    for name in BANDS:
        inside = F.col(f"_in_{name}")
        totals[f"{name}_n"] = F.when(inside, 1)
        totals[f"{name}_coarse"] = F.when(inside, F.col("_coarse"))
        totals[f"{name}_rest"] = F.when(inside, F.col("_rest"))
        totals[f"{name}_odd"] = F.when(inside & ~finite, F.when(F.col("exposure") > 0, 1).otherwise(NEGATIVE))
    return fold_running_totals(daily, totals, counts=False, exposure=True, broadcast_bytes=broadcast_bytes)


def band_means(
    births: DataFrame,
    bands: Blocks,
    first: int = 1,
    last: int = 91,
    empty: str = "null",
    identifier: bool = True,
) -> DataFrame:
    """Five band means per birth over the days ``first`` .. ``last``.

    Covers the births with an exposure on their first day. A band no day falls
    into is null, or NaN with ``empty="nan"``. ``identifier`` adds the number the
    birth has in the percentile dataset.
    """
    begun = exposure_on(births.where("RFA_ID IS NOT NULL"), bands, "pre", "_day_1").where("_day_1 IS NOT NULL")
    rows = begun.select("RFA_ID", "location", "admd", "pre", "tr3_end")
    if identifier:
        rows = number_rows(rows, DATASET_ORDER, name="Identifier")
    start = F.date_add("pre", first - 1)
    stop = F.greatest(start, F.least(F.date_add("pre", last), F.date_add("tr3_end", 1)))
    rows = totals_between(rows, bands, start, stop)
    empty_mean = "double('NaN')" if empty == "nan" else "double(NULL)"
    means = []
    for name in BANDS:
        odd = f"""CASE WHEN {name}_odd = 0 THEN ({name}_coarse + {name}_rest) / {name}_n
            WHEN {name}_odd < {NEGATIVE} THEN double('Infinity')
            WHEN {name}_odd % {NEGATIVE} = 0 THEN double('-Infinity') ELSE double('NaN') END"""
        mean = f"if({name}_n > 0, {odd}, {empty_mean})"
        if name in OUTER_BANDS:
            mean = f"if(days = {last - first + 1}, {mean}, NULL)"
        means.append(f"{mean} AS {name}")
    return rows.selectExpr("RFA_ID", "location", *means, *(["Identifier"] if identifier else []))


def band_means_of_days(
    long: DataFrame, percentiles: DataFrame, keys: Sequence[str], n_days: int, empty: str = "null"
) -> DataFrame:
    """The same means from day rows (``keys``, exposure), for tables already in long form.

    ``keys`` identify a birth and include location; ``n_days`` is the length of the range.
    """
    none = F.lit(float("nan")) if empty == "nan" else F.lit(None).cast("double")
    complete = F.count("exposure") == n_days
    means = []
    for name, band in BANDS.items():
        mean = F.coalesce(F.avg(F.when(F.expr(band), F.col("exposure"))), none)
        means.append((F.when(complete, mean) if name in OUTER_BANDS else mean).alias(name))
    return long.join(small(percentiles), "location", "left").groupBy(*keys).agg(*means)


def prepared_bands(
    weather: DataFrame,
    all_weather: DataFrame | None = None,
    bounds: tuple[int, int] | None = None,
    **options,
) -> Blocks:
    """``fold_bands`` with the percentiles of the same weather.

    Percentiles are taken over ``all_weather`` where it is given. With ``bounds``, ``weather`` comes without
    postcode bounds and is read once: percentiles are taken over all of it, bands within the bounds.
    """
    if bounds:
        all_weather = written(weather, "weather")
        weather = open_range(all_weather, "location", bounds)
    percentiles = location_percentiles(weather if all_weather is None else all_weather)
    return fold_bands(weather, written(percentiles, "percentiles"), **options)


def exposure_blocks(weather: DataFrame, **options) -> Blocks:
    """``fold_exposure`` of weather checked for repeated days."""
    return fold_exposure(daily_exposure(weather), **options)
