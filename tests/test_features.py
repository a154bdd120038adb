"""Running totals without a calendar, sweep, file order, selection, ledger, replacement, checked CSV, tree merge."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import small
from climagest.operators.births import gestation_dates, prepare_births
from climagest.operators.cohort import window_cohort
from climagest.operators.counts import flag_days, window_counts, window_counts_by_sweep
from climagest.operators.numbering import number_rows, run_ids
from climagest.operators.selection import bits_to_double, ordered_bits, values_at_ranks
from climagest.operators.weather import location_percentiles, prepare_weather
from climagest.operators.wide import map_groups
from climagest.schema import HEAT_FLAGS, PERCENTILES
from climagest.sources.ledger import Ledger
from climagest.sources.published import publish, read_published
from climagest.sources.readers import PLACE, read_births, read_checked_csv, read_weather
from climagest.sources.shared import fresh_path

HOT_DAY = {"Heatwave_days": 1}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def flagged(spark, days, zips=(29001,)):
    return prepare_weather(small.weather(spark, [(z, d, 20.0, HOT_DAY) for z in zips for d in days]), None, HEAT_FLAGS)


def dated(spark, *rows):
    return gestation_dates(prepare_births(small.births(spark, *rows)))


# -- totals by block -----------------------------------------------------------


@pytest.mark.parametrize("limit", [None, 0])
def test_a_day_far_off_adds_one_block(spark, limit):
    days = small.days_from(dt.date(2000, 1, 1), 700)[::3]
    births = dated(spark, *((i, 29001, dt.date(2000, 6, 1) + dt.timedelta(days=11 * i), 20 + i % 25) for i in range(40)))
    near = flag_days(flagged(spark, days), HEAT_FLAGS, broadcast_bytes=limit)
    far = flag_days(flagged(spark, [dt.date(9999, 12, 31), *days, dt.date(1, 1, 1)]), HEAT_FLAGS, broadcast_bytes=limit)
    assert far.blocks.frame.count() == near.blocks.frame.count() + 2
    assert rows_of(window_counts(births, far)) == rows_of(window_counts(births, near))


def test_windows_in_gaps_between_blocks(spark):
    """Window ends on days whose block holds no weather at all."""
    days = [dt.date(1990, 1, 1), dt.date(2000, 10, 10), dt.date(2000, 10, 11), dt.date(2010, 1, 1)]
    births = dated(spark, (1, 29001, dt.date(2001, 6, 15), 39), (2, 29001, dt.date(1980, 1, 1), 39), (3, 29001, dt.date(2020, 1, 1), 39))
    found = window_counts(births, flag_days(flagged(spark, days), HEAT_FLAGS)).select("RFA_ID", "window", "start", "End", "Heatwave")
    for _, _, start, end, heat in found.collect():
        assert heat == sum(start <= d <= end for d in days)


def test_sweep_equals_lookups_with_one_hot_postcode(spark):
    days = small.days_from(dt.date(1999, 1, 1), 900)
    weather = flagged(spark, days[::2], (29001,)).unionByName(flagged(spark, days[::7], (29004, 29007)))
    births = dated(
        spark, *((i, (29001, 29001, 29004, 29010)[i % 4], dt.date(1999, 6, 1) + dt.timedelta(days=i), 12 + i % 32) for i in range(300))
    )
    made = flag_days(weather, HEAT_FLAGS)
    assert rows_of(window_counts_by_sweep(window_cohort(births, weather), made)) == rows_of(window_counts(births, made))


# -- order of files ------------------------------------------------------------


def test_runs_start_anew_in_each_group(spark):
    rows = [("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("a", 4, 5), ("b", 1, 5), ("b", 2, 7)]
    found = run_ids(spark.createDataFrame(rows, "g string, at int, v int").repartition(4), "v", ["at"], within=["g"])
    assert [r.Number for r in found.orderBy("g", "at").collect()] == [1, 1, 2, 3, 1, 2]


def test_file_order_pairs_runs_as_they_lie(spark):
    """29001, 29004, 29001: three runs; the second postcode of the births meets the second run."""
    path = fresh_path(spark, "weather")
    day = dt.date(2001, 1, 1)
    for k, zip_code in enumerate((29001, 29004, 29001)):
        part = small.weather(spark, [(zip_code, day + dt.timedelta(days=k), 1.0, HOT_DAY)])
        part.coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    read = read_weather(spark, path, place=True)
    weather = prepare_weather(read, None, HEAT_FLAGS, keep=PLACE)
    births = dated(spark, (1, 29001, dt.date(2001, 3, 1), 39), (2, 29004, dt.date(2001, 3, 1), 39))
    found = window_counts(births, flag_days(weather, HEAT_FLAGS, align="file"), ["trimester3"])
    assert rows_of(found.select("RFA_ID", "Number", "Heatwave")) == [(1, 1, 1), (2, 2, 1)]
    runs = run_ids(weather, "location", PLACE).select("location", "date", "Number")
    assert [r.Number for r in runs.orderBy("date").collect()] == [1, 2, 3]


def test_no_place_outside_files(spark):
    with pytest.raises(ValueError):
        read_births(spark, _csv(spark, ["RFA_ID,ZIP,ADMD,GEST", "1,29001,1,39"]), "csv", place=True)


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_row_numbers_do_not_depend_on_the_division(spark, parts):
    rows = [(i % 50, i % 7, f"birth {i}") for i in range(1000)]
    table = spark.createDataFrame(rows, "RFA_ID int, ZIP int, note string")
    numbered = number_rows(table.repartition(parts), ["ZIP", "RFA_ID"], name="Identifier")
    again = number_rows(table.coalesce(1), ["ZIP", "RFA_ID"], name="Identifier")
    assert rows_of(numbered) == rows_of(again)


# -- selection -----------------------------------------------------------------


ODD = [0.0, -0.0, 1.0, -1.0, 1e-310, -1e-310, 1e308, -1e308, math.inf, -math.inf, 0.1, 0.2, 0.30000000000000004, 2.0**-1074]


def test_ordered_bits(spark):
    values = spark.createDataFrame([(v,) for v in ODD], "v double").select("v", ordered_bits(F.col("v")).alias("bits"))
    back = values.select("v", "bits", bits_to_double(F.col("bits")).alias("again")).collect()
    assert all(r.v == r.again for r in back)
    ordered = sorted(back, key=lambda r: r.bits % 2**64)
    assert [r.v for r in ordered] == sorted(r.v for r in back)


def test_values_at_ranks(spark):
    rng = np.random.default_rng(3)
    groups = {"wide": [*ODD, *(rng.standard_normal(500) * 10.0 ** rng.integers(-200, 200, 500))], "ties": [2.5] * 400 + [1.0], "one": [7.0]}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None)]
    ranks = [(g, k) for g, values in groups.items() for k in range(0, len(values) + 1, 13)]
    found = values_at_ranks(
        spark.createDataFrame(rows, "g string, v double").repartition(8), spark.createDataFrame(ranks, "g string, rank long"), ["g"], "v"
    )
    expected = sorted((g, k, sorted(groups[g])[k]) for g, k in ranks if k < len(groups[g]))
    assert sorted(map(tuple, found.select("g", "rank", "value").collect())) == expected


def test_selected_percentiles_have_the_bits_of_sorted_ones(spark):
    rng = np.random.default_rng(5)
    rows = [(z, float(v)) for z in range(5) for v in rng.normal(20, 9, 300 + z)] + [(9, None), (9, float("nan")), (10, 1.5)]
    weather = spark.createDataFrame(rows, "location int, exposure double")
    selected = {r.location: r for r in location_percentiles(weather, method="selected").collect()}
    for row in location_percentiles(weather, method="sorted").collect():
        assert all(selected[row.location][name] == row[name] for name in PERCENTILES)
    whole = {r.location: r for r in location_percentiles(weather, method="aggregate").collect()}
    assert whole.keys() == selected.keys() and selected[9].percentile_95 is None


# -- ledger, replacement, CSV --------------------------------------------------


def test_ledger(spark):
    ledger = Ledger()
    day = dt.date(2001, 6, 15)
    rows = [(1, "29001", day, "39"), (2, None, day, "39"), (3, "29x01", day, None), (4, "29945", day, "soon"), (5, "29001", day, "x")]
    assert prepare_births(small.births(spark, *rows), ledger=ledger).count() == 2
    found = {reason: n for _, reason, n in ledger.entries()}
    assert found == {"rows": 5, "zip_missing": 1, "zip_malformed": 1, "zip_out_of_bounds": 1, "gest_missing": 1, "gest_malformed": 2}
    with pytest.raises(ValueError):
        ledger.watch(spark.range(1), "births", {})


def test_replacement(spark):
    root = fresh_path(spark, "published")
    table = spark.createDataFrame([(29001, 1), (29004, 2), (29007, 3)], "location int, v int")
    publish(table, root)
    publish(table.withColumn("v", F.col("v") + 10), root, [29004, 29010])
    now = [(29001, 1), (29004, 12), (29007, 3)]
    assert rows_of(read_published(spark, root).select("location", "v")) == now
    broken = table.withColumn("v", F.when(F.col("location") == 29007, F.raise_error(F.lit("lost")).cast("int")).otherwise(99))
    with pytest.raises(PySparkException):
        publish(broken, root)
    assert rows_of(read_published(spark, root).select("location", "v")) == now
    publish(table.where("false"), root, [29001])
    assert rows_of(read_published(spark, root).select("location", "v")) == now[1:]
    publish(table, root)
    assert rows_of(read_published(spark, root).select("location", "v")) == [(29001, 1), (29004, 2), (29007, 3)]


def _csv(spark, lines):
    path = fresh_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_checked_csv(spark, mark):
    lines = ["RFA_ID,ZIP,ADMD,GEST", "1,29001,100,39", "2,29001", '3,"29,001",100,39', "4,29001,100,39,more", "5,,,"]
    rows, wrong = read_checked_csv(spark, _csv(spark, [line.replace(",", mark) for line in lines]))
    assert rows.columns == ["RFA_ID", "ZIP", "ADMD", "GEST"]
    assert rows_of(rows) == [("1", "29001", "100", "39"), ("3", f"29{mark}001", "100", "39"), ("5", None, None, None)]
    assert rows_of(wrong.select("text")) == [(lines[2].replace(",", mark),), (lines[4].replace(",", mark),)]
    assert wrong.where("file LIKE '%lines-%'").count() == 2


# -- grouped maps --------------------------------------------------------------


def test_pieces_merge_in_a_tree(spark):
    """100,000 rows of one group in pieces of ten; no call gets more than ``fan`` pieces."""
    table = spark.range(100_000).select(F.lit(29001).alias("location"), "id").unionByName(
        spark.range(5).select(F.lit(29004).alias("location"), "id")
    )
    fan = 16

    def begin(rows):
        return pd.DataFrame([{"first": rows["id"].iloc[0], "n": len(rows), "most": len(rows)}])

    def combine(pieces):
        assert (pieces["first"].diff().dropna() > 0).all()
        return pd.DataFrame([{"first": pieces["first"].iloc[0], "n": pieces["n"].sum(), "most": max(len(pieces), pieces["most"].max())}])

    def merge(pieces):
        whole = combine(pieces)
        return whole.assign(location=pieces["location"].iloc[0])[["location", "n", "most"]]

    found = map_groups(
        table, "location", ["id"], begin, "first long, n long, most long", merge, "location int, n long, most long", 10, combine, fan
    )
    assert rows_of(found) == [(29001, 100_000, fan), (29004, 5, 5)]
