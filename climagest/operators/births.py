"""Cleaning births and dating the pregnancy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climagest.functions.dates import admission_date, before_delivery, gestation_days, inclusive_days
from climagest.functions.numbers import number_column, whole_column
from climagest.operators.filters import open_range, pruned
from climagest.schema import MAX_SPAN_DAYS, POSTCODE_BOUNDS
from climagest.sources.ledger import Ledger


def prepare_births(
    births: DataFrame, bounds: tuple[int, int] | None = POSTCODE_BOUNDS, ledger: Ledger | None = None
) -> DataFrame:
    """RFA_ID, location, admd (date) and gest (weeks) of births inside the postcode bounds.

    ``ledger`` counts, as ``births``, the rows without or with a malformed postcode or number of weeks, and those out of bounds.
    """
    if ledger is not None:
        location, gest = whole_column(births, "ZIP"), number_column(births, "GEST")
        reasons = {
            "zip_missing": F.col("ZIP").isNull(),
            "zip_malformed": F.col("ZIP").isNotNull() & location.isNull(),
            "gest_missing": F.col("GEST").isNull(),
            "gest_malformed": F.col("GEST").isNotNull() & gest.isNull(),
        }
        if bounds:
            reasons["zip_out_of_bounds"] = ~((location > bounds[0]) & (location < bounds[1]))
        births = ledger.watch(births, "births", reasons)
    clean = pruned(births, "ZIP", bounds).select(
        "RFA_ID",
        whole_column(births, "ZIP").alias("location"),
        admission_date(births).alias("admd"),
        number_column(births, "GEST").alias("gest"),
    )
    return open_range(clean, "location", bounds) if bounds else clean


def gestation_dates(births: DataFrame) -> DataFrame:
    """Add the first day of the preconception window and of each trimester, and the last day."""
    admd, days = F.col("admd"), gestation_days(F.col("gest"))
    return births.withColumns(
        {
            "pre": before_delivery(admd, days, -1),
            "tr1": before_delivery(admd, days, 0),
            "tr2": before_delivery(admd, days, 1),
            "tr3": before_delivery(admd, days, 2),
            "tr3_end": admd,
        }
    )


def exposure_births(births: DataFrame, max_span_days: int = MAX_SPAN_DAYS) -> DataFrame:
    """Births for the exposure tables: dated, and without implausibly long pregnancies."""
    return (
        gestation_dates(births)
        .where(F.date_diff("tr3_end", "pre") <= max_span_days)
        .select(
            "location",
            "RFA_ID",
            "admd",
            "pre",
            "tr3_end",
            inclusive_days(F.col("pre"), F.col("tr3_end")).alias("n_days"),
        )
    )


def longest_span(births: DataFrame, by: str | None = None) -> DataFrame:
    """Largest number of days of any birth, overall or per ``by``."""
    return (births.groupBy(by) if by else births.groupBy()).agg(F.max("n_days").alias("max_days"))
