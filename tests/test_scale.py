"""The forms for large and uneven data give the same rows, and plans stay as meant."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import climagest as c
from climagest.catalogue import standin
from climagest.operators import weather as weather_module
from climagest.operators import wide
from climagest.schema import PERCENTILES
from climagest.sources import shared, writers

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cohort(spark):
    return c.exposure_births(c.prepare_births(standin.births(spark, FOLDER)))


@pytest.fixture(scope="module")
def temperature(spark):
    return c.prepare_weather(standin.temperature(spark, FOLDER))


def same(left, right):
    assert left.columns == right.columns
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_numbering_with_one_large_group_of_copies(spark):
    copies = spark.range(3000).select(F.lit(29001).alias("location"), F.lit(7).alias("v"))
    others = spark.range(500).select((29002 + F.col("id") % 5).cast("int").alias("location"), F.lit(1).alias("v"))
    numbered = c.number_rows(copies.unionByName(others), ["v"], within=["location"])
    sizes = {r["location"]: (r["n"], r["top"], r["low"]) for r in numbered.groupBy("location").agg(
        F.countDistinct("row").alias("n"), F.max("row").alias("top"), F.min("row").alias("low")).collect()}
    assert sizes == {29001: (3000, 3000, 1), **{29002 + k: (100, 100, 1) for k in range(5)}}


def test_copies_are_cut_into_several_stretches(spark):
    from climagest.operators.numbering import placed_in_order

    placed = placed_in_order(spark.range(8000).select(F.lit(1).alias("v")), ["v"])
    assert placed.select("_part").distinct().count() > 1


def test_run_ids_over_stretches(spark):
    values = [1, 1, 2, 2, 2, 1, 3, 3, 1, 1] * 30
    df = spark.createDataFrame(list(enumerate(values)), "k long, v int")
    got = [r["Number"] for r in c.run_ids(df, "v", ["k"]).orderBy("k").collect()]
    assert got == [1, *(1 + np.cumsum(np.diff(values) != 0)).tolist()]


def test_percentiles_by_sort_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(29001 + k % 3, float(v)) for k, v in enumerate(np.round(rng.normal(60, 20, 1000), 1))]
    rows += [(29001, float("nan")), (29001, None), (29009, 4.0)]
    df = spark.createDataFrame(rows, "location int, exposure double")
    for method in ("sorted", "aggregate"):
        for row in c.location_percentiles(df, method=method).collect():
            values = [v for z, v in rows if z == row["location"] and v is not None and v == v]
            for name, share in PERCENTILES.items():
                assert row[name] == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_percentile_method_follows_the_largest_postcode(spark, temperature, monkeypatch):
    calls = []
    real = weather_module._percentiles_by_sort
    monkeypatch.setattr(weather_module, "_percentiles_by_sort", lambda *a: calls.append(1) or real(*a))
    c.location_percentiles(temperature)
    assert not calls
    monkeypatch.setattr(weather_module, "VALUES_PER_LOCATION", 10)
    c.location_percentiles(temperature)
    assert calls


def test_band_means_match_numpy_closely(spark, cohort, temperature):
    """Running sums lose nothing against summing the days of each birth."""
    cuts = {r["location"]: r for r in c.location_percentiles(temperature).collect()}
    weather = {(r["location"], r["date"]): r["exposure"] for r in temperature.collect()}
    days = c.day_spine(cohort, 1, 200).groupBy("RFA_ID", "location").agg(F.array_sort(F.collect_list("date")).alias("d"))
    expected = {}
    for row in days.collect():
        values = [weather.get((row["location"], d)) for d in row["d"]]
        if values[0] is None:
            continue
        known, cut = np.array([v for v in values if v is not None]), cuts[row["location"]]
        inside = known[(known >= cut["percentile_10"]) & (known <= cut["percentile_90"])]
        expected[row["RFA_ID"]] = inside.mean() if len(inside) else None
    for limit in (2**29, 0):
        bands = c.prepared_bands(temperature, broadcast_bytes=limit)
        means = c.band_means(cohort, bands, 1, 200, identifier=False)
        got = {r["RFA_ID"]: r["mean_10th_to_90th"] for r in means.collect()}
        assert got.keys() == expected.keys()
        for key, value in expected.items():
            assert got[key] == (None if value is None else pytest.approx(value, abs=1e-12))


def test_shuffled_exposure_is_the_same(cohort, temperature):
    near, far = c.exposure_blocks(temperature), c.exposure_blocks(temperature, broadcast_bytes=0)
    assert near.fits and not far.fits
    same(c.day_exposure(cohort, near), c.day_exposure(cohort, far))
    wide = c.exposure_wide(cohort, near, 393)
    same(wide, c.exposure_wide(cohort, far, 393))
    days = c.day_exposure(cohort, near)
    same(days, c.attach_exposure(c.day_spine(cohort), near))
    back = c.unpivot_days(wide, ["location", "RFA_ID"]).where("value IS NOT NULL")
    long = days.where("exposure IS NOT NULL").selectExpr(
        "location", "RFA_ID", "concat('Day_', day_idx) AS name", "exposure AS value"
    )
    same(back, long)


def test_identical_births_keep_their_rows(spark):
    births = standin.births(spark, FOLDER).limit(50)
    twice = births.unionByName(births)
    hot = standin.weather(spark, FOLDER)
    once, both = c.hot_window_counts(births, hot), c.hot_window_counts(twice, hot)
    same(once.unionByName(once), both)


def test_counting_does_not_move_births(spark):
    dated = c.gestation_dates(c.prepare_births(standin.births(spark, FOLDER)))
    weather = c.prepare_weather(standin.weather(spark, FOLDER), None, c.HEAT_FLAGS)
    counted = c.window_counts(dated, c.flag_days(weather, c.HEAT_FLAGS))
    text = plan(counted)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "SortMergeJoin" not in text
    # the only exchanges below the births' joins belong to small sides
    spine = [line for line in text.splitlines() if line.lstrip(": ").startswith("+- Exchange")]
    assert all("hashpartitioning(location" in line or "SinglePartition" in line for line in spine)


@pytest.mark.parametrize("method", ["interval", "bucketed", "days"])
def test_joins_have_an_equality(spark, method):
    dated = c.gestation_dates(c.prepare_births(standin.births(spark, FOLDER)))
    weather = c.prepare_weather(standin.weather(spark, FOLDER), None, c.HEAT_FLAGS)
    cohort = c.window_cohort(dated, weather)
    text = plan(c.window_counts_by_join(cohort, c.flag_days(weather, c.HEAT_FLAGS), method))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "Python" not in text


def test_postcode_filter_and_columns_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "births")
    standin.births(spark, FOLDER).withColumn("unused", F.lit(1)).write.parquet(path)
    text = plan(c.prepare_births(spark.read.parquet(path)))
    assert "GreaterThan(ZIP,29000)" in text and "LessThan(ZIP,29945)" in text and "unused" not in text


def test_pivot_of_scattered_days(spark):
    """Repeated, missing and outside days, null keys and values, in any order; days are not grouped one by one."""
    rows = [(i % 7 if i % 11 else None, i % 3, 1 + i * 5 % 12, None if i % 6 == 0 else float(i * 7 % 19)) for i in range(300)]
    rows += [(99, 0, 400, 1.0), (98, 0, None, 2.0), (97, 1, 3, None), (96, 1, 2, float("-inf")), (95, 2, 4, float("nan")), (95, 2, 4, 5.0)]
    for parts in (1, 5):
        long = spark.createDataFrame(rows, "location int, RFA_ID long, day_idx int, exposure double").repartition(parts)
        pivoted = wide.pivot_days(long, ["location", "RFA_ID"], 2, 9)
        expected = {(a, b): [None] * 8 for a, b, _, _ in rows}
        for a, b, day, value in rows:
            if day is not None and 2 <= day <= 9 and value is not None:
                values, at = expected[a, b], day - 2
                values[at] = value if values[at] is None or value != value or value > values[at] else values[at]
        found = pivoted.collect()
        assert len(found) == len(expected)
        assert all(repr(list(r)[2:]) == repr(expected[r.location, r.RFA_ID]) for r in found)
        assert pivoted.columns[2:] == [f"Day_{k}" for k in range(2, 10)]
        assert "pivotfirst" not in pivoted._jdf.queryExecution().optimizedPlan().toString().lower()


def test_narrow_rows_are_dealt(spark, monkeypatch):
    """Steps that make many values of a row deal the rows over tasks first, however few files they lie in."""
    monkeypatch.setattr(shared, "TASK_VALUES", 200)
    births = spark.range(50, numPartitions=1).toDF("RFA_ID")
    assert shared.spread(births, 40).rdd.getNumPartitions() == 10
    assert sorted(r.RFA_ID for r in shared.spread(births, 40).collect()) == list(range(50))
    assert shared.spread(births, 4).rdd.getNumPartitions() == 1


def test_rows_laid_by_location(spark, tmp_path):
    """Wide rows that lie by postcode are written where they are: no shuffle, few files, the same rows."""
    path = str(tmp_path / "laid")
    rows = spark.range(300).selectExpr("CAST(29001 + id % 3 AS INT) AS location", "id AS RFA_ID")
    writers.write_by_location(rows.repartitionByRange(6, "location", "RFA_ID").sortWithinPartitions("location", "RFA_ID"), path, laid=True)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("location", "RFA_ID", "zip_part").collect()) == [
        (29001 + k, i, 29001 + k) for k in range(3) for i in range(k, 300, 3)
    ]
    assert len(list((tmp_path / "laid").glob("zip_part=*/*.parquet"))) <= 6 + 3


def laid_births(spark, copies=40):
    """Births of two postcodes, several on each first day, in mixed order, and weather on every day."""
    first = dt.date(2001, 1, 1)
    rows = [(29401 + 3 * (i % 2), 1000 - i, first + dt.timedelta(days=i % 5), 4 + i % 3) for i in range(copies)]
    births = spark.createDataFrame([(z, r, p, p, p + dt.timedelta(days=n - 1), n) for z, r, p, n in rows],
                                   "location int, RFA_ID long, admd date, pre date, tr3_end date, n_days int")
    days = [(z, first + dt.timedelta(days=k), float(z % 7 + k)) for z in (29401, 29404) for k in range(20)]
    return births, c.exposure_blocks(spark.createDataFrame(days, "location int, date date, exposure double"))


def parts_of(df, columns):
    return [part for part in df.select(*columns).rdd.map(tuple).glom().collect() if part]


def test_wide_births_lie_by_postcode_and_first_day(spark, monkeypatch):
    """Births with the same exposures lie next to each other, also behind the joins with the weather."""
    monkeypatch.setattr(shared, "TASK_VALUES", 40)
    births, blocks = laid_births(spark)
    order = ["location", "pre", "tr3_end", "RFA_ID"]
    parts = parts_of(c.exposure_wide(births, blocks, 6), order)
    assert 3 <= len(parts) and sum(map(len, parts)) == 40
    assert [row for part in parts for row in part] == sorted(row for part in parts for row in part)
    parts = parts_of(c.day_exposure(births, blocks), [*order, "date"])
    assert [row for part in parts for row in part] == sorted(row for part in parts for row in part)
    copies = births.limit(1).crossJoin(spark.range(40)).drop("id")
    assert len(parts_of(c.exposure_wide(copies, blocks, 6), order)) >= 3


def test_wide_days_end_with_the_birth(spark):
    """Days after delivery, and of births without an end or delivered before they begin, are null."""
    births, blocks = laid_births(spark, 3)
    odd = births.withColumn("tr3_end", F.expr("CASE RFA_ID WHEN 1000 THEN NULL WHEN 999 THEN date_sub(pre, 2) ELSE tr3_end END"))
    found = {r.RFA_ID: list(r)[5:] for r in c.exposure_wide(odd, blocks, 8).collect()}
    assert found[1000] == found[999] == [None] * 8
    assert found[998] == [29401 % 7 + 2.0 + k for k in range(6)] + [None, None]


def test_unpivot_has_one_step_for_all_days(spark):
    """No projection for each day column, of which each task would compile hundreds."""
    rows = [(29401, 1, 1.5, None, 2.0), (None, 2, None, None, None), (None, 2, None, float("nan"), 0.0)]
    table = spark.createDataFrame(rows, "location int, RFA_ID long, Day_9 double, Day_10 double, Day_11 double")
    long = wide.unpivot_days(table, ["location", "RFA_ID"])
    assert long.columns == ["location", "RFA_ID", "name", "value"]
    expected = [(r[0], r[1], f"Day_{9 + k}", r[2 + k]) for r in rows for k in range(3)]
    assert sorted(map(repr, map(tuple, long.collect()))) == sorted(map(repr, expected))
    assert "Expand" not in plan(long)


def test_pivot_of_laid_days_moves_nothing(spark, monkeypatch):
    """The days of births that ``day_exposure`` divided among tasks are put together where they are."""
    monkeypatch.setattr(shared, "TASK_VALUES", 40)
    births, blocks = laid_births(spark)
    keys = ["location", "RFA_ID", "admd", "pre", "tr3_end"]
    pivoted = wide.pivot_days(c.day_exposure(births.unionByName(births.limit(7)), blocks, whole=True), keys, 1, 6)
    same(pivoted, c.exposure_wide(births, blocks, 6))
    text = plan(pivoted)
    assert "rangepartitioning(" in text and "hashpartitioning(" not in text and "MapInArrow" not in text
    parts = parts_of(pivoted, ["location", "pre", "tr3_end", "RFA_ID"])
    assert [row for part in parts for row in part] == sorted(row for part in parts for row in part)


def test_dataset_lies_by_postcode_and_first_day(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_VALUES", 40)
    births, blocks = laid_births(spark)
    percentiles = spark.createDataFrame([(z, 4.0, 3.0, 2.0, 1.0) for z in (29401, 29404)], ["location", *PERCENTILES])
    percentiles = percentiles.withColumn("location", F.col("location").cast("int"))
    dataset = c.percentile_dataset(births, blocks, percentiles, 6)
    parts = parts_of(dataset, ["location", "pre", "tr3_end", "RFA_ID", "Identifier"])
    rows = [row for part in parts for row in part]
    assert len(parts) >= 3 and rows == sorted(rows)
    numbers = sorted((r[0], r[3], r[4]) for r in rows)
    assert [n for _, _, n in numbers] == list(range(1, 41))
