"""The queries, each over whole tables.

Where a result has one row per birth and day it is summed up by postcode and day
at the end, after every row has been produced, to keep the comparison readable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from climagest.catalogue import standin
from climagest.functions.columns import between_columns, matching, move_after, named_like
from climagest.operators.bands import (
    BANDS,
    band_means,
    band_means_of_days,
    exposure_blocks,
    percentile_dataset,
    prepared_bands,
    thresholds,
)
from climagest.operators.births import exposure_births, gestation_dates, longest_span, prepare_births
from climagest.operators.cohort import COHORT_COLUMNS, window_cohort
from climagest.operators.counts import flag_days, window_counts, window_counts_by_join, window_counts_by_sweep
from climagest.operators.filters import any_column_in, flagged_days, open_range
from climagest.operators.numbering import number_rows, number_values, run_ids
from climagest.operators.spine import attach_exposure, day_exposure, day_spine, padded_dates
from climagest.operators.weather import (
    births_with_weather,
    daily_exposure,
    location_frequency,
    location_percentiles,
    prepare_weather,
)
from climagest.operators.wide import exposure_wide, map_groups, nest, pivot_days, stack_tables, unnest, unpivot_days
from climagest.plans.exposure import exposure_long, write_exposure_wide, write_percentile_dataset
from climagest.plans.extremes import extreme_day_counts, write_extreme_day_counts
from climagest.schema import DAY_ZERO, FLAGS, PERCENTILES, POSTCODE_BOUNDS, WEATHER, WINDOWS
from climagest.sources.ledger import SCHEMA as LEDGER
from climagest.sources.published import publish, read_published
from climagest.sources.readers import PLACE, list_locations, read_births, read_checked_csv, read_location, read_weather
from climagest.sources.shared import fresh_path, written
from climagest.sources.writers import (
    write_by_location,
    write_counts_by_window,
    write_csv,
    write_table,
    write_window_counts,
)

REPLACED = (29401, 29112)

Query = Callable[[SparkSession, str], DataFrame]


def settled(column: Column | str, places: int) -> Column:
    """Rounded for comparison. A first, finer rounding removes the noise of summation,
    so that values lying exactly between two numbers go the same way everywhere."""
    return F.round(F.round(column, places + 4), places)


def rounded(df: DataFrame, columns: Iterable[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: settled(c, places) for c in columns})


# -- inputs ------------------------------------------------------------------


def _births(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_births(standin.births(spark, folder))


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return gestation_dates(_births(spark, folder))


def _cohort(spark: SparkSession, folder: str) -> DataFrame:
    return exposure_births(_births(spark, folder))


def _temperature(spark: SparkSession, folder: str, **options) -> DataFrame:
    return prepare_weather(standin.temperature(spark, folder), **options)


def _flags(spark: SparkSession, folder: str, family: str = "Hot") -> DataFrame:
    return prepare_weather(standin.weather(spark, folder, family), None, FLAGS[family])


def _bands(spark: SparkSession, folder: str):
    return prepared_bands(_temperature(spark, folder, bounds=None), bounds=POSTCODE_BOUNDS)


# -- births and weather ------------------------------------------------------


def births_clean_text(spark: SparkSession, folder: str) -> DataFrame:
    return prepare_births(standin.text_births(spark, folder))


def gestation_dates_text(spark: SparkSession, folder: str) -> DataFrame:
    return gestation_dates(births_clean_text(spark, folder))


def births_from_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "births-csv")
    write_csv(standin.text_births(spark, folder), path)
    return prepare_births(read_births(spark, path, "csv"))


def epoch_dates(spark: SparkSession, folder: str) -> DataFrame:
    births = prepare_births(standin.births(spark, folder), bounds=None)
    return births.select(
        "RFA_ID",
        "admd",
        F.unix_date("admd").alias("unix_day"),
        F.date_from_unix_date(F.unix_date("admd")).alias("admd_again"),
    )


def matched_births(spark: SparkSession, folder: str) -> DataFrame:
    return births_with_weather(_births(spark, folder), _temperature(spark, folder))


def zip_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return location_frequency(_temperature(spark, folder))


def any_zip_column_filter(spark: SparkSession, folder: str) -> DataFrame:
    zips = _temperature(spark, folder).select("location")
    return any_column_in(standin.two_zip_births(spark, folder), "zip", zips)


def flag_query(spark: SparkSession, folder: str, family: str, flag: str) -> DataFrame:
    return flagged_days(_flags(spark, folder, family), flag)


def zip_run_id(spark: SparkSession, folder: str) -> DataFrame:
    weather = _temperature(spark, folder, bounds=None)
    return weather.join(number_values(weather, "location"), "location").select("location", "date", "Number")


def zip_run_id_unsorted(spark: SparkSession, folder: str) -> DataFrame:
    return run_ids(_births(spark, folder).select("RFA_ID", "location"), "location", ["RFA_ID"])


def birth_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder).select("location", "RFA_ID", "admd", "pre")
    in_location = number_rows(births, ["RFA_ID", "admd", "pre"], within=["location"])
    return number_rows(in_location, ["location", "row"], name="Identifier")


def longest_spans(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder)
    return stack_tables([longest_span(births, "location"), longest_span(births)])


# -- windows and counts ------------------------------------------------------


def cohort_query(spark: SparkSession, folder: str, window: str) -> DataFrame:
    return window_cohort(_dated(spark, folder), _flags(spark, folder), [window])


def counts_query(spark: SparkSession, folder: str, family: str, windows: tuple[str, ...]) -> DataFrame:
    births, weather = standin.births(spark, folder), standin.weather(spark, folder, family)
    return extreme_day_counts(births, weather, family, windows)


def counts_by_join(spark: SparkSession, folder: str, method: str) -> DataFrame:
    dated, weather = _dated(spark, folder), _flags(spark, folder)
    return window_counts_by_join(window_cohort(dated, weather), flag_days(weather, FLAGS["Hot"]), method)


def counts_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The counts as they run when the weather is too large for a broadcast."""
    return window_counts(_dated(spark, folder), flag_days(_flags(spark, folder), FLAGS["Hot"], broadcast_bytes=0))


def counts_ordinal(spark: SparkSession, folder: str, family: str) -> DataFrame:
    return window_counts(
        _dated(spark, folder), flag_days(_flags(spark, folder, family), FLAGS[family], align="ordinal")
    )


def counts_by_sweep(spark: SparkSession, folder: str) -> DataFrame:
    dated, weather = _dated(spark, folder), written(_flags(spark, folder), "weather")
    return window_counts_by_sweep(window_cohort(dated, weather), flag_days(weather, FLAGS["Hot"]))


def _in_order(df: DataFrame, *order: str) -> DataFrame:
    """``df`` laid out by unique ``order`` over several files, as a table in a given order is stored."""
    return df.repartitionByRange(5, *order).sortWithinPartitions(*order)


def counts_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of postcodes as the weather lies in its files, which here go month by month, so that every postcode comes back."""
    path = fresh_path(spark, "weather")
    weather = standin.weather(spark, folder).withColumn("month", F.trunc("Date", "month"))
    write_table(_in_order(weather, "month", "Zip", "Date").drop("month"), path)
    stored = read_weather(spark, path, place=True)
    weather = prepare_weather(stored, None, FLAGS["Hot"], keep=PLACE)
    return window_counts(_dated(spark, folder), flag_days(weather, FLAGS["Hot"], align="file"))


def repeated_births_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Births of which some come twice, differing only in weeks, numbered by record and, where it repeats, by place in the files."""
    path = fresh_path(spark, "births")
    births = standin.births(spark, folder)
    again = births.where("RFA_ID % 3 = 0").withColumn("GEST", F.col("GEST") + 2)
    stored = births.unionByName(again).withColumn("RFA_ID", F.floor(F.col("RFA_ID") / 4).cast("long"))
    write_table(_in_order(stored.withColumn("turn", F.col("ADMD") * 7 % 31), "turn", "RFA_ID", "ADMD", "ZIP", "GEST").drop("turn"), path)
    placed = open_range(read_births(spark, path, place=True), "ZIP", POSTCODE_BOUNDS)
    return number_rows(placed, ["ZIP", "RFA_ID"], name="Identifier", ties=PLACE).drop(*PLACE)


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Cold counts of one window from CSV weather, written to CSV and read back."""
    weather_path, output = fresh_path(spark, "weather-csv"), fresh_path(spark, "counts")
    write_csv(standin.weather(spark, folder, "Cold"), weather_path)
    weather = read_weather(spark, weather_path, "Cold", "csv")
    counts = extreme_day_counts(standin.births(spark, folder), weather, "Cold", ("preconception",))
    path = write_window_counts(counts, output, "Cold", WINDOWS["preconception"])
    names = FLAGS["Cold"].values()
    schema = "ZIP int, ADMD date, RFA_ID long, Pre date, End date, Number int, " + ", ".join(f"{n} long" for n in names)
    return spark.read.csv(path, header=True, schema=schema)


def births_csv_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Births in CSV with another delimiter and broken lines: the rows as they are read, and the lines kept apart."""
    path = fresh_path(spark, "births-csv")
    births, key = standin.births(spark, folder), F.col("RFA_ID")
    whole = F.concat_ws(";", "RFA_ID", "ZIP", "ADMD", "GEST")
    short = F.concat_ws(";", "RFA_ID", "ZIP")
    line = F.when(key % 29 == 0, short).when(key % 31 == 0, F.concat(whole, F.lit(";more;fields"))).otherwise(whole)
    births.select(line.alias("RFA_ID;ZIP;ADMD;GEST")).write.option("header", True).option("sep", "\x01").csv(path)
    rows, wrong = read_checked_csv(spark, path)
    kept = rows.select(F.lit("row").alias("kind"), F.concat_ws(",", *rows.columns).alias("text"))
    return kept.unionByName(wrong.select(F.lit("line").alias("kind"), "text"))


def cleaning_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What cleaning dropped on the way from CSV births to the window files, by table and reason."""
    births, weather = fresh_path(spark, "births-csv"), fresh_path(spark, "weather")
    write_csv(standin.text_births(spark, folder), births)
    write_table(standin.weather(spark, folder), weather)
    output = fresh_path(spark, "counts")
    write_extreme_day_counts(spark, births, weather, output, "Hot", "csv", "parquet")
    return spark.read.csv(f"{output}/Hot_ledger.csv", header=True, schema=LEDGER)


def partition_replace(spark: SparkSession, folder: str) -> DataFrame:
    """Band means by postcode of which two postcodes are written a second time, read back."""
    root = fresh_path(spark, "published")
    means = written(bands_query(spark, folder, 1, 91), "means")
    publish(means, root)
    publish(means.withColumn("Identifier", F.col("Identifier") + 1_000_000), root, REPLACED)
    return read_published(spark, root).drop("zip_part")


def births_from_csv_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Births whose delivery stands in CSV as a date, some as a day number, some not at all."""
    path = fresh_path(spark, "births-csv")
    births = standin.births(spark, folder)
    day = F.date_add(F.lit(DAY_ZERO).cast("date"), F.col("ADMD")).cast("string")
    key = F.col("RFA_ID")
    admitted = F.when(key % 5 == 0, F.col("ADMD").cast("string")).when(key % 7 != 0, day)
    write_csv(births.withColumn("ADMD", admitted), path)
    return prepare_births(read_births(spark, path, "csv", "long"))


def weather_text_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet weather with the postcode as text, some of it malformed."""
    path = fresh_path(spark, "weather")
    zip_text = F.col("Zip").cast("string")
    weather = standin.temperature(spark, folder)
    write_table(weather.withColumn("Zip", F.when(F.dayofmonth("Date") == 13, F.concat(zip_text, F.lit("x"))).otherwise(zip_text)), path)
    return rounded(daily_exposure(prepare_weather(read_weather(spark, path))), ["exposure"])


def _stored_inputs(spark: SparkSession, folder: str, family: str) -> tuple[str, str]:
    births, weather = fresh_path(spark, "births"), fresh_path(spark, "weather")
    write_table(standin.births(spark, folder), births)
    write_table(standin.weather(spark, folder, family), weather)
    return births, weather


def window_files(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """From Parquet files to the five CSV files of a family, read back."""
    output = fresh_path(spark, "counts")
    paths = write_extreme_day_counts(spark, *_stored_inputs(spark, folder, family), output, family)
    counts = ", ".join(f"{n} long" for n in FLAGS[family].values())
    parts = []
    for window, path in zip(WINDOWS.values(), paths):
        schema = f"ZIP int, ADMD date, RFA_ID long, {window.start_label} date, End date, Number int, {counts}"
        part = spark.read.csv(path, header=True, schema=schema).withColumnRenamed(window.start_label, "start")
        parts.append(part.withColumn("window", F.lit(window.name)))
    return stack_tables(parts)


def counts_by_window_files(spark: SparkSession, folder: str) -> DataFrame:
    """All windows in one CSV dataset divided by window, read back."""
    births, weather = standin.births(spark, folder), standin.weather(spark, folder)
    path = write_counts_by_window(extreme_day_counts(births, weather, "Hot"), fresh_path(spark, "counts"))
    counts = ", ".join(f"{n} long" for n in FLAGS["Hot"].values())
    schema = f"ZIP int, ADMD date, RFA_ID long, start date, End date, Number int, {counts}, window string"
    return spark.read.csv(path, header=True, schema=schema)


# -- days and exposure -------------------------------------------------------


def day_spine_summary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        day_spine(_cohort(spark, folder))
        .groupBy("location", "day_idx")
        .agg(
            F.count("*").alias("n_births"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.sum(F.unix_date("date")).alias("sum_of_days"),
            F.sum(F.unix_date("date") * _mark()).alias("marked_days"),
        )
    )


def _mark() -> Column:
    """A small number that tells births apart: sums weighted by it change if two births swap their values."""
    return F.col("RFA_ID") % 97


def _by_day(days: DataFrame) -> DataFrame:
    summed = days.groupBy("location", "day_idx").agg(
        F.count("*").alias("n_births"),
        F.count("exposure").alias("n_exposed"),
        F.sum("exposure").alias("sum_exposure"),
        F.min("exposure").alias("min_exposure"),
        F.max("exposure").alias("max_exposure"),
        F.sum(F.col("exposure") * _mark()).alias("marked_exposure"),
    )
    return rounded(rounded(summed, ["min_exposure", "max_exposure"]), ["sum_exposure", "marked_exposure"], 2)


def day_exposure_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _by_day(day_exposure(_cohort(spark, folder), exposure_blocks(_temperature(spark, folder))))


def attached_exposure_summary(spark: SparkSession, folder: str) -> DataFrame:
    days = day_spine(_cohort(spark, folder))
    return _by_day(attach_exposure(days, exposure_blocks(_temperature(spark, folder))))


def day_exposure_padded(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder)
    longest = longest_span(births).first()["max_days"] or 0
    return (
        padded_dates(births, longest)
        .select("location", F.posexplode("dates").alias("position", "date"))
        .groupBy("location", "position")
        .agg(
            F.count("date").alias("n_dates"),
            F.count_if(F.col("date").isNull()).alias("n_padded"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def exposure_calculation(spark: SparkSession, folder: str) -> DataFrame:
    """Every step from raw births to daily exposure, then one line per birth."""
    days = exposure_long(standin.births(spark, folder), standin.temperature(spark, folder))
    summed = days.groupBy("location", "birth_row", "RFA_ID", "admd").agg(
        F.count("*").alias("n_days"),
        F.count("exposure").alias("n_exposed"),
        F.min("date").alias("first_date"),
        F.avg("exposure").alias("mean_exposure"),
        F.max("exposure").alias("max_exposure"),
    )
    return rounded(summed, ["mean_exposure", "max_exposure"])


def exposure_of_other_column(spark: SparkSession, folder: str) -> DataFrame:
    """Any numeric weather column can be the exposure, here a flag."""
    weather = prepare_weather(standin.weather(spark, folder), "Heatwave_days")
    return _by_day(day_exposure(_cohort(spark, folder), exposure_blocks(weather)))


def _wide(spark: SparkSession, folder: str, **options) -> DataFrame:
    births = _cohort(spark, folder)
    n_days = longest_span(births).first()["max_days"] or 0
    return exposure_wide(births, exposure_blocks(_temperature(spark, folder), **options), n_days)


def wide_query(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(spark, folder)


def wide_file(spark: SparkSession, folder: str, exposure_col: str = "TAVG") -> DataFrame:
    """The wide exposure table from files to a file, read back."""
    births, weather = _stored_inputs(spark, folder, "Hot")
    if exposure_col not in WEATHER["Hot"].names:
        other = fresh_path(spark, "weather")
        write_table(spark.read.parquet(weather).withColumn(exposure_col, F.col("TAVG") * 2), other)
        weather = other
    output = fresh_path(spark, "wide")
    write_exposure_wide(spark, births, weather, output, exposure_col)
    return spark.read.parquet(output)


def wide_trimester1(spark: SparkSession, folder: str) -> DataFrame:
    """A run of day columns chosen by name, behind the postcode."""
    wide = _wide(spark, folder)
    days = between_columns(wide, "Day_92", "Day_182")
    return move_after(wide.select("location", *days, "RFA_ID"), ["RFA_ID"], "location")


def wide_missing_days(spark: SparkSession, folder: str) -> DataFrame:
    """How many of the day columns are empty, with the columns found by prefix and by pattern."""
    wide = _wide(spark, folder)

    def empty(names: list[str]) -> str:
        return " + ".join(f"int({name} IS NULL)" for name in names)

    return wide.selectExpr(
        "location",
        "RFA_ID",
        f"{empty(named_like(wide, 'Day_1'))} AS empty_by_prefix",
        f"{empty(matching(wide, '^Day_9'))} AS empty_by_pattern",
    )


def pivoted_days(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder)
    days = day_exposure(births, exposure_blocks(_temperature(spark, folder)), whole=True)
    last = longest_span(births).first()["max_days"] or 0
    return pivot_days(days, ["location", "RFA_ID", "admd", "pre", "tr3_end"], 1, last)


def unpivoted_days(spark: SparkSession, folder: str) -> DataFrame:
    wide = _wide(spark, folder)
    return (
        unpivot_days(wide.drop("admd", "pre", "tr3_end"), ["location", "RFA_ID"])
        .groupBy("location", "name")
        .agg(
            F.count("*").alias("n_births"),
            F.count("value").alias("n_exposed"),
            settled(F.sum("value"), 2).alias("sum_value"),
            settled(F.sum(F.col("value") * _mark()), 2).alias("marked_value"),
        )
    )


def nested_by_location(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder).select("location", "RFA_ID", "admd", "pre", "n_days")
    return unnest(nest(births, "location", ["RFA_ID"], rows=1000)).drop("piece")


def nested_sizes(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder).select("location", "RFA_ID", "admd", "pre", "n_days")
    nested = nest(births, "location", ["RFA_ID"], rows=1000)
    return nested.select("location", "piece", F.size("data").cast("long").alias("n_births"))


def grouped_map_streaks(spark: SparkSession, folder: str) -> DataFrame:
    """The longest run of days on which the temperature rose, per postcode, by a pandas function on its ordered days.

    Of a piece one has to know its ends and the runs that touch them; runs across pieces are
    then put together. A missing day ends a run.
    """

    def runs(days: pd.DataFrame) -> pd.DataFrame:
        values = days["exposure"].to_numpy()
        rises = (values[1:] > values[:-1]) & (days["day"].diff().to_numpy()[1:] == 1)
        longest = now = head = 0
        for i, rise in enumerate(rises, 1):
            now = now + 1 if rise else 0
            longest, head = max(longest, now), now if now == i else head
        ends = {"first_day": days["day"].iloc[0], "last_day": days["day"].iloc[-1], "first": values[0], "last": values[-1]}
        return pd.DataFrame([{**ends, "n": len(values), "head": head, "tail": now, "longest": longest}])

    def together(pieces: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for piece in pieces.to_dict("records"):
            if whole is None:
                whole = piece
                continue
            meets = piece["first_day"] == whole["last_day"] + 1 and piece["first"] > whole["last"]
            across = whole["tail"] + 1 + piece["head"] if meets else 0
            head = across if meets and whole["head"] == whole["n"] - 1 else whole["head"]
            tail = across if meets and piece["tail"] == piece["n"] - 1 else piece["tail"]
            longest = max(whole["longest"], piece["longest"], across)
            ends = {"first_day": whole["first_day"], "first": whole["first"], "last_day": piece["last_day"], "last": piece["last"]}
            whole = {**whole, **ends, "n": whole["n"] + piece["n"], "head": head, "tail": tail, "longest": longest}
        return pd.DataFrame([whole])

    def joined(pieces: pd.DataFrame) -> pd.DataFrame:
        whole = together(pieces)
        return whole.rename(columns={"n": "n_days", "longest": "longest_rise"})[["location", "n_days", "longest_rise"]]

    days = _temperature(spark, folder).where("exposure IS NOT NULL").select("location", F.unix_date("date").alias("day"), "exposure")
    partial_schema = "first_day int, last_day int, first double, last double, n long, head long, tail long, longest long"
    schema = "location int, n_days long, longest_rise long"
    return map_groups(days, "location", ["day"], runs, partial_schema, joined, schema, rows=100, combine=together, fan=8)


# -- percentiles and bands ---------------------------------------------------


def percentiles_query(spark: SparkSession, folder: str, method: str = "auto") -> DataFrame:
    weather = _temperature(spark, folder, bounds=None)
    return rounded(location_percentiles(weather, method=method), PERCENTILES)


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    births = _cohort(spark, folder)
    n_days = longest_span(births).first()["max_days"] or 0
    weather = written(_temperature(spark, folder, bounds=None), "weather")
    percentiles = written(location_percentiles(weather), "percentiles")
    blocks = exposure_blocks(open_range(weather, "location", POSTCODE_BOUNDS))
    return percentile_dataset(births, blocks, percentiles, n_days)


def dataset_query(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_dataset(spark, folder), PERCENTILES)


def _stored_dataset(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "dataset")
    write_percentile_dataset(spark, *_stored_inputs(spark, folder, "Hot"), path)
    return path


def dataset_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """The percentile dataset written by postcode, read back."""
    return rounded(spark.read.parquet(_stored_dataset(spark, folder)).drop("zip_part"), PERCENTILES)


def bands_from_partition(spark: SparkSession, folder: str) -> DataFrame:
    """Band means of one postcode from its directory of the stored dataset and a chosen range of its columns."""
    dataset = read_location(spark, _stored_dataset(spark, folder), 29401)
    keys = ["location", "RFA_ID", "Identifier"]
    days = between_columns(dataset, "Day_1", "Day_91")
    long = unpivot_days(dataset.select(*keys, *days), keys).withColumnRenamed("value", "exposure")
    means = band_means_of_days(long, thresholds(dataset), keys, len(days))
    return rounded(means.select("RFA_ID", "location", *BANDS, "Identifier"), BANDS)


def thresholds_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(thresholds(_dataset(spark, folder)), PERCENTILES)


def bands_query(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    means = band_means(_cohort(spark, folder), _bands(spark, folder), first, last)
    return rounded(means, BANDS)


def bands_from_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Band means the long way: from a stored wide dataset, unpivoted again."""
    path = fresh_path(spark, "dataset")
    write_table(_dataset(spark, folder), path)
    dataset = spark.read.parquet(path)
    keys = ["location", "RFA_ID", "Identifier"]
    days = between_columns(dataset, "Day_1", "Day_91")
    long = unpivot_days(dataset.select(*keys, *days), keys).withColumnRenamed("value", "exposure")
    means = band_means_of_days(long, thresholds(dataset), keys, len(days))
    return rounded(means.select("RFA_ID", "location", *BANDS, "Identifier"), BANDS)


def _stored_bands(spark: SparkSession, folder: str) -> str:
    path = fresh_path(spark, "bands")
    write_by_location(bands_query(spark, folder, 1, 91), path)
    return path


def partition_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(_stored_bands(spark, folder))


def one_location(spark: SparkSession, folder: str) -> DataFrame:
    return read_location(spark, _stored_bands(spark, folder), 29401).drop("zip_part")


def location_list(spark: SparkSession, folder: str) -> DataFrame:
    return list_locations(spark, _stored_bands(spark, folder))


def daily_weather(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(daily_exposure(_temperature(spark, folder)), ["exposure"])


QUERIES: dict[str, Query] = {
    "births_clean": _births,
    "births_clean_text": births_clean_text,
    "births_from_csv": births_from_csv,
    "births_from_csv_dates": births_from_csv_dates,
    "births_csv_checked": births_csv_checked,
    "cleaning_ledger": cleaning_ledger,
    "weather_text_zip": weather_text_zip,
    "weather_clean": daily_weather,
    "gestation_dates": _dated,
    "gestation_dates_text": gestation_dates_text,
    "exposure_births": _cohort,
    "births_with_weather": matched_births,
    "zip_frequency": zip_frequency,
    "any_zip_column_filter": any_zip_column_filter,
    **{
        f"flag_days_{family.lower()}_{flag}": partial(flag_query, family=family, flag=flag)
        for family, flags in FLAGS.items()
        for flag in flags
    },
    "epoch_dates": epoch_dates,
    "zip_run_id": zip_run_id,
    "zip_run_id_unsorted": zip_run_id_unsorted,
    "birth_row_numbers": birth_row_numbers,
    "birth_row_numbers_repeated": repeated_births_numbered,
    "longest_spans": longest_spans,
    **{f"cohort_{window}": partial(cohort_query, window=window) for window in WINDOWS},
    **{
        f"{family.lower()}_counts_{window}": partial(counts_query, family=family, windows=(window,))
        for family in FLAGS
        for window in WINDOWS
    },
    **{
        f"{family.lower()}_counts_all": partial(counts_query, family=family, windows=tuple(WINDOWS)) for family in FLAGS
    },
    "hot_counts_interval": partial(counts_by_join, method="interval"),
    "hot_counts_bucketed": partial(counts_by_join, method="bucketed"),
    "hot_counts_spine": partial(counts_by_join, method="days"),
    "hot_counts_shuffled": counts_shuffled,
    "hot_counts_sweep": counts_by_sweep,
    "hot_counts_file_order": counts_file_order,
    "hot_counts_ordinal": partial(counts_ordinal, family="Hot"),
    "cold_counts_ordinal": partial(counts_ordinal, family="Cold"),
    "csv_roundtrip": csv_roundtrip,
    "hot_window_files": partial(window_files, family="Hot"),
    "cold_window_files": partial(window_files, family="Cold"),
    "hot_counts_by_window": counts_by_window_files,
    "day_spine": day_spine_summary,
    "day_exposure": day_exposure_summary,
    "day_exposure_attached": attached_exposure_summary,
    "day_exposure_padded": day_exposure_padded,
    "exposure_calculation": exposure_calculation,
    "exposure_of_flag": exposure_of_other_column,
    "exposure_wide": wide_query,
    "exposure_wide_file": wide_file,
    "exposure_wide_other_column": partial(wide_file, exposure_col="TDOUBLE"),
    "exposure_wide_trimester1": wide_trimester1,
    "exposure_wide_missing": wide_missing_days,
    "exposure_pivot": pivoted_days,
    "exposure_unpivot": unpivoted_days,
    "nested_by_location": nested_by_location,
    "nested_sizes": nested_sizes,
    "grouped_map_streaks": grouped_map_streaks,
    "location_percentiles": percentiles_query,
    "location_percentiles_sorted": partial(percentiles_query, method="sorted"),
    "location_percentiles_selected": partial(percentiles_query, method="selected"),
    "percentile_dataset": dataset_query,
    "percentile_dataset_partitioned": dataset_partitioned,
    "band_means_from_partition": bands_from_partition,
    "thresholds_distinct": thresholds_distinct,
    "band_means_pre": partial(bands_query, first=1, last=91),
    "band_means_tr2": partial(bands_query, first=183, last=273),
    "band_means_first_14": partial(bands_query, first=1, last=14),
    "band_means_from_wide": bands_from_wide,
    "partition_roundtrip": partition_roundtrip,
    "partition_replace": partition_replace,
    "one_location": one_location,
    "location_list": location_list,
}
