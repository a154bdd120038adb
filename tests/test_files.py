"""Whole calculations from files to files."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import climagest as c
from climagest.catalogue import standin

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("files"))
    c.write_table(standin.births(spark, FOLDER), f"{root}/births")
    c.write_table(standin.weather(spark, FOLDER, "Hot"), f"{root}/hot")
    c.write_csv(standin.births(spark, FOLDER), f"{root}/births_csv")
    c.write_csv(standin.weather(spark, FOLDER, "Cold"), f"{root}/cold_csv")
    return root


def test_window_count_files(spark, files):
    hot = c.write_extreme_day_counts(spark, f"{files}/births", f"{files}/hot", f"{files}/out", "Hot")
    cold = c.write_extreme_day_counts(spark, f"{files}/births_csv", f"{files}/cold_csv", f"{files}/out", "Cold", "csv")
    assert [os.path.basename(p) for p in hot] == [
        "Preconception_Hot.csv",
        "Trimester1_Hot.csv",
        "Trimester2_Hot.csv",
        "Trimester2_Preme_Hot.csv",
        "Trimester3_Hot.csv",
    ]
    starts = ["Pre", "Tr1", "Tr2", "Tr2", "Tr3"]
    for path, start, flags in [(p, s, c.HEAT_FLAGS) for p, s in zip(hot, starts)] + [
        (p, s, c.COLD_FLAGS) for p, s in zip(cold, starts)
    ]:
        table = spark.read.csv(path, header=True)
        assert table.columns == ["ZIP", "ADMD", "RFA_ID", start, "End", "Number", *flags.values()]
        assert table.count() > 0


def test_exposure_files(spark, files):
    c.write_exposure_wide(spark, f"{files}/births", f"{files}/hot", f"{files}/wide")
    wide = spark.read.parquet(f"{files}/wide")
    assert wide.columns[:6] == ["location", "RFA_ID", "admd", "pre", "tr3_end", "Day_1"]
    assert wide.columns[-1] == "Day_393"

    c.write_percentile_dataset(spark, f"{files}/births", f"{files}/hot", f"{files}/dataset")
    dataset = spark.read.parquet(f"{files}/dataset")
    total = dataset.count()
    assert 0 < total < wide.count()
    assert dataset.agg(F.countDistinct("Identifier").alias("n"), F.max("Identifier").alias("m")).first() == (total, total)

    c.write_band_means(spark, f"{files}/births", f"{files}/hot", f"{files}/means", 1, 14)
    means = spark.read.parquet(f"{files}/means")
    assert means.select("RFA_ID", "Identifier").exceptAll(dataset.select("RFA_ID", "Identifier")).count() == 0
    assert means.count() == total
    listed = {row["zip_part"] for row in c.list_locations(spark, f"{files}/means").collect()}
    one = sorted(listed)[0]
    part = c.read_location(spark, f"{files}/means", one)
    assert {row["location"] for row in part.collect()} == {one}
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", part._jdf.queryExecution().executedPlan().toString())[1]
    assert f"= {one}" in filters
