"""Cleaning weather, folding it to one row per postcode and day, and its percentiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climagest.functions.numbers import drop_nan, whole_column
from climagest.operators.filters import open_range, pruned
from climagest.operators.numbering import placed_in_order, totals_before
from climagest.operators.selection import values_at_ranks
from climagest.schema import PERCENTILES, POSTCODE_BOUNDS
from climagest.sources.shared import small, written

# Above this many values in one postcode the percentiles are read off a
# distributed sort instead of one aggregation state per postcode.
VALUES_PER_LOCATION = 1_000_000


def prepare_weather(
    weather: DataFrame,
    exposure_col: str | None = "TAVG",
    flags: Iterable[str] = (),
    bounds: tuple[int, int] | None = POSTCODE_BOUNDS,
    keep: Iterable[str] = (),
) -> DataFrame:
    """location, date, exposure (any numeric weather column), the wanted flags and the columns ``keep``."""
    columns = [
        whole_column(weather, "Zip").alias("location"),
        F.col("Date").cast("date").alias("date"),
    ]
    if exposure_col is not None:
        columns.append(drop_nan(exposure_col).alias("exposure"))
    columns += [F.col(name) for name in (*flags, *keep)]
    clean = pruned(weather, "Zip", bounds).select(*columns)
    return open_range(clean, "location", bounds) if bounds else clean


def location_frequency(weather: DataFrame) -> DataFrame:
    """How many weather rows each postcode has."""
    return weather.groupBy("location").agg(F.count("*").alias("N"))


def births_with_weather(births: DataFrame, weather: DataFrame) -> DataFrame:
    """Births whose postcode occurs in the weather."""
    return births.join(small(written(weather.select("location").distinct(), "locations")), "location", "left_semi")


def daily_flag_counts(weather: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Flagged rows per postcode and day. Repeated weather rows all count."""
    return (
        weather.where(F.col("date").isNotNull())
        .groupBy("location", "date")
        .agg(*(F.count_if(F.col(flag) == 1).alias(name) for flag, name in flags.items()))
    )


def daily_exposure(weather: DataFrame) -> DataFrame:
    """The exposure of each postcode and day; a day given twice is an error."""
    repeated = F.concat(
        F.lit("weather holds more than one row for postcode "),
        F.col("location").cast("string"),
        F.lit(" on "),
        F.col("date").cast("string"),
    )
    return (
        weather.where(F.col("date").isNotNull())
        .groupBy("location", "date")
        .agg(F.count("*").alias("_rows"), F.min("exposure").alias("_value"))
        .select(
            "location",
            "date",
            F.when(F.col("_rows") > 1, F.raise_error(repeated).cast("double"))
            .otherwise(F.col("_value"))
            .alias("exposure"),
        )
    )


def location_percentiles(
    weather: DataFrame,
    percentiles: Mapping[str, float] = PERCENTILES,
    method: str = "auto",
) -> DataFrame:
    """Exact percentiles of the exposure per postcode, interpolated between neighbours.

    ``method``: "aggregate" keeps the values of a postcode in one aggregation
    state, "sorted" reads them off a distributed sort, "auto" picks by the
    largest number of values any postcode has, "selected" narrows the values down digit by digit
    without sorting them, and "approximate" opts out of exactness for very large inputs.
    """
    if method == "auto":
        most = (
            weather.groupBy("location").agg(F.count("exposure").alias("n")).agg(F.max("n").alias("n")).first()["n"]
        )
        method = "aggregate" if (most or 0) <= VALUES_PER_LOCATION else "sorted"
    if method == "sorted":
        return _percentiles_by_sort(weather, percentiles)
    if method == "selected":
        return _percentiles_by_selection(weather, percentiles)
    shares = F.array(*(F.lit(share) for share in percentiles.values()))
    function = F.percentile_approx if method == "approximate" else F.percentile
    return (
        weather.groupBy("location")
        .agg(function(drop_nan("exposure"), shares).alias("_p"))
        .select("location", *(F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(percentiles)))
    )


def _percentiles_by_selection(weather: DataFrame, percentiles: Mapping[str, float]) -> DataFrame:
    """Percentiles from the values at the two ranks around each of them."""
    values = written(weather.select("location", drop_nan("exposure").alias("value")), "values")
    sizes = written(values.groupBy("location").agg(F.count("value").alias("n")), "sizes")
    shares = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in percentiles.items()))
    placed = sizes.where("n > 0").select("location", "n", F.inline(shares)).withColumn("at", (F.col("n") - 1) * F.col("share"))
    placed = placed.withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    ranks = placed.select("location", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = values_at_ranks(values, ranks, ["location"], "value")
    picked = placed.join(small(found), "location").groupBy("location").agg(
        *(
            column
            for name in percentiles
            for column in (
                F.max(F.when((F.col("name") == name) & (F.col("rank") == F.col("low")), F.col("value"))).alias(f"_low_{name}"),
                F.max(F.when((F.col("name") == name) & (F.col("rank") == F.col("high")), F.col("value"))).alias(f"_high_{name}"),
                F.max(F.when(F.col("name") == name, F.col("at") - F.col("low"))).alias(f"_part_{name}"),
            )
        )
    )
    none = sizes.where("n = 0").select("location")
    return _between_neighbours(picked, percentiles).unionByName(none, allowMissingColumns=True)


def _percentiles_by_sort(weather: DataFrame, percentiles: Mapping[str, float]) -> DataFrame:
    """Percentiles without gathering a postcode: equal values are merged first,
    the distinct ones sorted across all tasks, and each value then covers the
    ranks ``first_rank`` .. ``last_rank`` (from 0) of its postcode."""
    exposure = drop_nan("exposure")
    values = (
        weather.select("location", exposure.alias("value"))
        .where("value IS NOT NULL")
        .groupBy("location", "value")
        .agg(F.count("*").alias("copies"))
    )
    placed = placed_in_order(values, ["location", "value"])
    earlier = totals_before(placed, ["location"], F.sum("copies"))
    within = Window.partitionBy("_part", "location").orderBy("_pos")
    ranked = (
        placed.join(earlier, ["location", "_part"])
        .withColumn("last_rank", F.col("_before") + F.sum("copies").over(within) - 1)
        .withColumn("first_rank", F.col("last_rank") - F.col("copies") + 1)
    )
    sizes = small(placed.groupBy("location").agg(F.sum("copies").alias("n")))
    ranked = ranked.join(sizes, "location")

    def value_at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("first_rank"), F.col("last_rank")), F.col("value")))

    bounds = []
    for name, share in percentiles.items():
        position = (F.col("n") - 1) * F.lit(share)
        bounds += [
            value_at(F.floor(position)).alias(f"_low_{name}"),
            value_at(F.ceil(position)).alias(f"_high_{name}"),
            F.max(position - F.floor(position)).alias(f"_part_{name}"),
        ]
    return _between_neighbours(ranked.groupBy("location").agg(*bounds), percentiles)


def _between_neighbours(picked: DataFrame, percentiles: Mapping[str, float]) -> DataFrame:
    return picked.select(
        "location",
        *(
            F.when(F.col(f"_low_{name}") == F.col(f"_high_{name}"), F.col(f"_low_{name}"))
            .otherwise(
                F.col(f"_low_{name}") * (1 - F.col(f"_part_{name}")) + F.col(f"_high_{name}") * F.col(f"_part_{name}")
            )
            .alias(name)
            for name in percentiles
        ),
    )
