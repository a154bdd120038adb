"""The days of each birth and the exposure on them, one row per birth and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from climagest.functions.columns import pad_with_nulls
from climagest.functions.dates import day_sequence
from climagest.operators.blocks import (
    Blocks,
    block_of,
    exposure_on,
    first_day_of_block,
    join_blocks,
)
from climagest.schema import MAX_SPAN_DAYS
from climagest.sources.shared import spread

#: Births of a postcode that begin on the same day have the same exposure on each day until one ends. Next to each other
#: their days take little room once they are stored, and sums by postcode and day are made of few rows.
BIRTH_ORDER = ("location", "pre", "tr3_end", "RFA_ID")


def _range(first: int, last: int | None) -> tuple[Column, Column]:
    """Dates of the days ``first`` .. ``last`` (counted from 1), cut at delivery."""
    start = F.date_add("pre", first - 1)
    end = F.col("tr3_end") if last is None else F.least(F.date_add("pre", last - 1), F.col("tr3_end"))
    return start, end


def day_spine(births: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """One row per birth and day: ``day_idx`` from 1 at the preconception start, and ``date``.

    The bounds go into the generated sequence; a later filter on ``day_idx``
    would first generate every day and then drop most of them.
    """
    start, end = _range(first, last)
    return births.select(
        *births.columns, F.posexplode(day_sequence(start, end)).alias("_at", "date")
    ).select(*births.columns, (F.col("_at") + first).alias("day_idx"), "date")


def attach_exposure(days: DataFrame, blocks: Blocks) -> DataFrame:
    """Add the exposure of the row's postcode and date; null where there is none."""
    return exposure_on(days, blocks, "date")


def day_exposure(
    births: DataFrame, blocks: Blocks, first: int = 1, last: int | None = None, whole: bool = False
) -> DataFrame:
    """``day_spine`` followed by ``attach_exposure``, meeting the weather once per
    birth and row of blocks instead of once per birth and day. With ``whole``, for what groups days by birth again,
    copies of a birth stay in one task."""
    start, end = _range(first, last)
    ranged = births.withColumn("_start", start).withColumn("_end", end).where("_start <= _end")
    touched = F.sequence(block_of(F.col("_start")), block_of(F.col("_end")), F.lit(blocks.reach))
    order = [name for name in BIRTH_ORDER if name in births.columns]
    laid = spread(ranged, MAX_SPAN_DAYS, order, whole) if blocks.fits else ranged
    split = laid.withColumn("_touched", F.explode(touched))
    met = join_blocks(split, blocks, "location", F.col("_touched"), {"exposure": "_values"})
    met = met.withColumn("_from", first_day_of_block(F.col("_touched")))
    beyond = first_day_of_block(F.col("_touched") + blocks.reach)
    opening = F.greatest(F.col("_start"), F.col("_from"))
    closing = F.least(F.col("_end"), F.date_sub(beyond, 1))
    return met.select(
        *births.columns, "_values", "_from", F.explode(day_sequence(opening, closing)).alias("date")
    ).select(
        *births.columns,
        (F.date_diff("date", "pre") + 1).alias("day_idx"),
        "date",
        F.get("_values", F.date_diff("date", "_from")).alias("exposure"),
    )


def padded_dates(births: DataFrame, length: int) -> DataFrame:
    """The dates of each birth as one array, filled up with nulls to ``length``."""
    dates = day_sequence(F.col("pre"), F.col("tr3_end"))
    return births.withColumn("dates", pad_with_nulls(dates, length, "date"))
