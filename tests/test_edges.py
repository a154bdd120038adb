"""Hand-computed cases."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import climagest as c
from small import DELIVERY, births, days_from, weather

HOT = c.HEAT_FLAGS


def dated(spark, *rows):
    return c.gestation_dates(c.prepare_births(births(spark, *rows)))


def windows_of(spark, gest):
    cohort = c.window_cohort(
        dated(spark, (1, 29001, DELIVERY, gest)),
        c.prepare_weather(weather(spark, [(29001, DELIVERY, 1.0, {})]), None, HOT),
    )
    return {row["window"]: (row["start"], row["End"]) for row in cohort.collect()}


@pytest.mark.parametrize(
    ("gest", "later"),
    [
        (13, set()),
        (14, {"trimester2_preterm"}),
        (25, {"trimester2_preterm"}),
        (26, set()),
        (27, {"trimester2", "trimester3"}),
        (44, {"trimester2", "trimester3"}),
    ],
)
def test_windows_by_gestation(spark, gest, later):
    assert set(windows_of(spark, gest)) == {"preconception", "trimester1"} | later


def test_windows_tile_the_pregnancy(spark):
    found = windows_of(spark, 39)
    spans = [found[w] for w in ("preconception", "trimester1", "trimester2", "trimester3")]
    assert spans[0][0] == DELIVERY - dt.timedelta(days=39 * 7 + 91)
    assert spans[-1][1] == DELIVERY
    for (_, end), (start, _) in zip(spans, spans[1:]):
        assert start == end + dt.timedelta(days=1)


def test_span_cap_only_for_exposure(spark):
    rows = [(1, 29001, DELIVERY, 43), (2, 29001, DELIVERY, 44)]
    kept = c.exposure_births(c.prepare_births(births(spark, *rows))).collect()
    assert [(row["RFA_ID"], row["n_days"]) for row in kept] == [(1, 393)]
    assert dated(spark, *rows).count() == 2


def test_postcode_bounds_and_malformed_values(spark):
    table = births(
        spark,
        (1, "29000", DELIVERY, "39"),
        (2, "29001", DELIVERY, "39"),
        (3, "29944", DELIVERY, "38.5"),
        (4, "29945", DELIVERY, "39"),
        (5, "29x01", DELIVERY, "39"),
        (6, None, DELIVERY, "39"),
        (7, " 29002 ", DELIVERY, "x"),
        (8, "29003d", DELIVERY, "39"),
        (9, "29004.0", DELIVERY, None),
    )
    kept = {row["RFA_ID"]: (row["location"], row["gest"]) for row in c.prepare_births(table).collect()}
    assert kept == {2: (29001, 39.0), 3: (29944, 38.5), 7: (29002, None), 9: (29004, None)}
    pre = c.gestation_dates(c.prepare_births(table)).where("RFA_ID = 3").first()["pre"]
    assert pre == DELIVERY - dt.timedelta(days=270 + 91)  # 38.5 weeks are 269.5 days; dates round down


def test_births_without_gestation_reach_no_window(spark):
    table = dated(spark, (1, "29001", DELIVERY, "x"), (2, "29001", DELIVERY, "39"))
    flags = c.prepare_weather(weather(spark, [(29001, DELIVERY, 1.0, {})]), None, HOT)
    assert {row["RFA_ID"] for row in c.window_counts(table, c.flag_days(flags, HOT)).collect()} == {2}


def test_counts(spark):
    pre = DELIVERY - dt.timedelta(days=39 * 7 + 91)
    rows = [
        (29001, pre - dt.timedelta(days=1), 1.0, {"Heatwave_days": 1}),  # day before
        (29001, pre, 1.0, {"Heatwave_days": 1}),
        (29001, pre, 1.0, {"Heatwave_days": 1}),  # repeated rows count
        (29001, pre + dt.timedelta(days=90), 1.0, {"Heatwave_days": 1, "Above_95th": 1}),
        (29001, pre + dt.timedelta(days=91), 1.0, {"Heatwave_days": 1}),  # first of trimester 1
        (29001, DELIVERY, 1.0, {"Heatwave_days": 1}),
        (29001, DELIVERY + dt.timedelta(days=1), 1.0, {"Heatwave_days": 1}),  # day after
        (29003, pre, 1.0, {}),
    ]
    table = dated(spark, (1, 29001, DELIVERY, 39), (2, 29002, DELIVERY, 39), (3, 29003, DELIVERY, 39))
    flags = c.prepare_weather(weather(spark, rows), None, HOT)
    for days in (c.flag_days(flags, HOT), c.flag_days(flags, HOT, broadcast_bytes=0)):
        counted = {
            (row["RFA_ID"], row["window"]): (row["Heatwave"], row["Above_95th"], row["No_Heatwave"])
            for row in c.window_counts(table, days).collect()
        }
        assert counted == {
            (1, "preconception"): (3, 1, 0),
            (1, "trimester1"): (1, 0, 0),
            (1, "trimester2"): (0, 0, 0),
            (1, "trimester3"): (1, 0, 0),
            **{(3, w): (0, 0, 0) for w in ("preconception", "trimester1", "trimester2", "trimester3")},
        }


def test_counts_outside_the_weather_and_before_1970(spark):
    delivery = dt.date(1962, 3, 1)
    rows = [(29001, day, 1.0, {"Heatwave_days": 1}) for day in days_from(dt.date(1961, 9, 1), 40)]
    table = dated(
        spark, (1, 29001, delivery, 39), (2, 29001, dt.date(1960, 1, 1), 39), (3, 29001, dt.date(1990, 1, 1), 39)
    )
    days = c.flag_days(c.prepare_weather(weather(spark, rows), None, HOT), HOT)
    got = c.window_counts(table, days).groupBy("RFA_ID").agg(F.sum("Heatwave").alias("n")).collect()
    assert {row["RFA_ID"]: row["n"] for row in got} == {1: 40, 2: 0, 3: 0}


def test_ordinal_alignment_pairs_by_rank(spark):
    """A postcode without a flagged day shifts the pairing."""
    rows = [(29001, DELIVERY, 1.0, {}), (29003, DELIVERY, 1.0, {"Heatwave_days": 1})]
    table = dated(spark, (1, 29001, DELIVERY, 39), (2, 29003, DELIVERY, 39))
    flags = c.prepare_weather(weather(spark, rows), None, HOT)

    def heat(align):
        counts = c.window_counts(table, c.flag_days(flags, HOT, align), ["trimester3"]).collect()
        return {row["RFA_ID"]: row["Heatwave"] for row in counts}

    assert heat("postcode") == {1: 0, 2: 1}
    assert heat("ordinal") == {1: 1, 2: 0}


def test_repeated_weather_day_fails_for_exposure(spark):
    repeated = weather(spark, [(29001, DELIVERY, 1.0, {}), (29001, DELIVERY, 2.0, {})])
    with pytest.raises(Exception, match="more than one row for postcode 29001 on 2001-06-15"):
        c.exposure_blocks(c.prepare_weather(repeated))


# -- bands on days 1 .. 4, thresholds 10, 20, 80, 90 -------------------------


def band_row(spark, values, gest=39, last=4, **options):
    cohort = c.exposure_births(c.prepare_births(births(spark, (1, 29001, DELIVERY, gest))))
    pre = DELIVERY - dt.timedelta(days=gest * 7 + 91)
    rows = [(29001, day, value, {}) for day, value in zip(days_from(pre, len(values)), values) if value is not None]
    cut = spark.createDataFrame(
        [(29001, 90.0, 80.0, 20.0, 10.0)],
        "location int, percentile_95 double, percentile_90 double, percentile_10 double, percentile_05 double",
    )
    bands = c.fold_bands(c.prepare_weather(weather(spark, rows)), cut)
    found = c.band_means(cohort, bands, 1, last, identifier=False, **options).collect()
    return tuple(found[0])[2:] if found else None


def test_bands_share_their_edges(spark):
    assert band_row(spark, [20.0, 10.0, 80.0, 90.0]) == (None, 15.0, 50.0, 85.0, None)


def test_outer_bands(spark):
    assert band_row(spark, [5.0, 7.0, 91.0, 50.0]) == (6.0, None, 50.0, None, 91.0)


@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_day_spoils_outer_bands_only(spark, missing):
    assert band_row(spark, [5.0, missing, 91.0, 50.0]) == (None, None, 50.0, None, None)


def test_range_beyond_delivery_spoils_outer_bands(spark):
    values = [5.0] + [50.0] * 91
    assert band_row(spark, values[:92], gest=0, last=93) == (None, None, 50.0, None, None)
    assert band_row(spark, values[:92], gest=0, last=92) == (5.0, None, 50.0, None, None)


def test_first_day_needs_exposure(spark):
    assert band_row(spark, [None, 5.0, 91.0, 50.0]) is None


def test_empty_band_as_nan(spark):
    below, low, middle, high, above = band_row(spark, [50.0] * 4, empty="nan")
    assert middle == 50.0 and all(math.isnan(v) for v in (below, low, high, above))


def test_padding(spark):
    cohort = c.exposure_births(c.prepare_births(births(spark, (1, 29001, DELIVERY, 1), (2, 29001, DELIVERY, 2))))
    dates = {row["RFA_ID"]: row["dates"] for row in c.padded_dates(cohort, 106).collect()}
    assert [len(d) for d in dates.values()] == [106, 106]
    assert dates[1][98] == DELIVERY and dates[1][99:] == [None] * 7
    assert dates[2][105] == DELIVERY
