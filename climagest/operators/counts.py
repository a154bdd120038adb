"""Flagged days of a birth's postcode inside its pregnancy windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from climagest.functions.dates import day_sequence
from climagest.operators.blocks import (
    Blocks,
    block_of,
    fold_running_totals,
    totals_at,
)
from climagest.operators.cohort import COHORT_COLUMNS, in_windows, numbered_locations
from climagest.operators.numbering import number_rows, placed_in_order, run_ids
from climagest.operators.weather import daily_flag_counts
from climagest.schema import WINDOWS
from climagest.sources.ledger import Ledger
from climagest.sources.readers import PLACE
from climagest.sources.shared import SMALL_ROWS, has_at_most, small, written


@dataclass(frozen=True)
class FlagDays:
    """Weather ready for counting: read once, used for every window.

    ``daily``: stored counts per postcode and day. ``blocks``: running totals,
    keyed by postcode or, for the ordinal alignment, by run id.
    """

    daily: DataFrame
    blocks: Blocks
    ordinal: bool


def flag_days(
    weather: DataFrame,
    flags: Mapping[str, str],
    align: str = "postcode",
    broadcast_bytes: int | None = None,
) -> FlagDays:
    """Fold the flags of ``weather`` (from ``prepare_weather``).

    ``align="ordinal"`` pairs the n-th postcode with births with the n-th
    postcode having a day of the flag, instead of pairing equal postcodes. ``align="file"`` pairs it with the flag's
    n-th run of rows of one postcode as they lie in the file; the weather then carries the columns ``PLACE``, and a
    postcode that comes back is a new run. Both exist to compare with results made that way.
    """
    names = tuple(flags.values())
    if align == "file":
        weather = written(weather, "weather")
    daily = written(daily_flag_counts(weather, flags), "flag-days")
    ordinal = align != "postcode"
    keyed = daily
    if ordinal:
        keyed = written(_by_run_id(daily, names) if align == "ordinal" else _by_file_run(weather, flags), "flag-runs")
    blocks = fold_running_totals(keyed, {name: F.col(name) for name in names}, broadcast_bytes=broadcast_bytes)
    return FlagDays(daily, blocks, ordinal)


def window_counts(
    births: DataFrame, days: FlagDays, windows: Sequence[str] = tuple(WINDOWS), ledger: Ledger | None = None
) -> DataFrame:
    """Ten counts per birth and window.

    Windows share their ends, so the running totals are looked up at most five times per birth (at
    the start of each part of the pregnancy and the day after delivery), subtracted, and only then
    laid out by window. With broadcast blocks the births are neither shuffled nor expanded by day.
    """
    blocks = days.blocks
    locations = days.daily.select("location").distinct()
    numbers = numbered_locations(births, locations, blocks.few)
    chosen = [WINDOWS[name] for name in windows]
    key = "Number" if days.ordinal else "location"
    ends = list(dict.fromkeys(end for w in chosen for end in (w.start, w.stop or "_after")))
    rows = births.join(numbers, "location").withColumn("_after", F.date_add("admd", 1))
    rows = totals_at(rows, blocks, ends, key)
    looked_up = lambda w: {"_from": f"_at_{w.start}", "_to": f"_at_{w.stop or '_after'}"}
    laid_out = in_windows(rows, chosen, looked_up, ledger)
    counts = (f"CAST(coalesce(_to[{k}], 0) - coalesce(_from[{k}], 0) AS BIGINT) AS {n}" for k, n in enumerate(blocks.names))
    return laid_out.selectExpr("window", *COHORT_COLUMNS, *counts)


def window_counts_by_join(cohort: DataFrame, days: FlagDays, method: str = "bucketed") -> DataFrame:
    """The same counts by joining intervals with days.

    ``method``: "interval" joins on the postcode and tests each day, "bucketed"
    first splits intervals into 32-day blocks, so that a day is compared only with
    intervals touching its block, "days" writes out every day of an interval.

    Births sharing postcode, start and end share the counts, so the join runs over
    the distinct intervals and its result is joined back.
    """
    names = days.blocks.names
    keys = ["ZIP", "start", "End"]
    intervals = cohort.select(*keys).distinct()
    weather = days.daily.withColumnRenamed("location", "ZIP")
    if method == "interval":
        pairs = intervals.join(weather, (intervals.ZIP == weather.ZIP) & F.col("date").between(F.col("start"), F.col("End")), "left")
        pairs = pairs.drop(weather.ZIP)
    elif method == "bucketed":
        touched = F.sequence(block_of(F.col("start")), block_of(F.col("End")))
        split = intervals.withColumn("block", F.explode(touched))
        pairs = (
            split.join(weather.withColumn("block", block_of(F.col("date"))), ["ZIP", "block"], "left")
            # a block without weather still stands for its interval, with a null date
            .withColumn("_inside", F.col("date").between(F.col("start"), F.col("End")))
        )
        pairs = pairs.select(*keys, *(F.when(F.col("_inside"), F.col(n)).alias(n) for n in names))
    elif method == "days":
        spread = intervals.withColumn("date", F.explode(day_sequence(F.col("start"), F.col("End"))))
        pairs = spread.join(weather, ["ZIP", "date"], "left")
    else:
        raise ValueError(f"unknown method {method!r}")
    counted = pairs.groupBy(*keys).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names))
    return cohort.join(counted, keys, "left").select("window", *COHORT_COLUMNS, *names)


def window_counts_by_sweep(cohort: DataFrame, days: FlagDays) -> DataFrame:
    """The same counts by one pass over days and window ends in order of postcode and date.

    The running totals at every distinct window end come out of one range-partitioned sort: those
    within a stretch of it, plus those of the postcode's earlier stretches. Nothing is broadcast but the totals of
    stretches, no row is copied, and a postcode with most rows is cut over as many stretches as it needs.
    """
    names = days.blocks.names
    stopped = cohort.withColumn("_stop", F.date_add("End", 1))
    ends = stopped.select(F.col("ZIP").alias("location"), F.explode(F.array("start", "_stop")).alias("date")).distinct()
    # at an end come first its totals, then the day itself
    events = ends.select("location", "date", F.lit(0).alias("_kind"), *(F.lit(0).cast("long").alias(n) for n in names))
    events = events.unionByName(days.daily.select("location", "date", F.lit(1).alias("_kind"), *names))
    placed = placed_in_order(events, ["location", "date", "_kind"], unique=True)

    stretches = placed.groupBy("location", "_part").agg(*(F.sum(n).alias(n) for n in names))
    earlier = Window.partitionBy("location").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*(F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names))
    stretches = small(written(stretches.select("location", "_part", before.alias("_before")), "stretches"))
    upto = Window.partitionBy("_part", "location").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.select("location", "date", "_kind", "_part", F.array(*(F.sum(n).over(upto) for n in names)).alias("_inside"))
    points = inside.where("_kind = 0").join(stretches, ["location", "_part"])
    total = F.zip_with("_before", "_inside", lambda earlier, here: earlier + here)
    points = written(points.select(F.col("location").alias("ZIP"), "date", total.alias("_total")), "points")

    rows = stopped
    for end in ("start", "_stop"):
        rows = rows.join(points.select("ZIP", F.col("date").alias(end), F.col("_total").alias(f"_at_{end}")), ["ZIP", end])
    counts = (f"_at__stop[{k}] - _at_start[{k}] AS {name}" for k, name in enumerate(names))
    return rows.selectExpr("window", *COHORT_COLUMNS, *counts)


def _by_file_run(weather: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Counts keyed by the number of the run of one postcode, among the rows of each flag in file order."""
    rows = weather.where(F.col("date").isNotNull()).unpivot(["location", "date", *PLACE], list(flags), "flag", "n").where("n = 1")
    numbered = run_ids(rows, "location", PLACE, within=["flag"])
    return numbered.groupBy(F.col("Number").alias("location"), "date").agg(
        *(F.count_if(F.col("flag") == flag).alias(name) for flag, name in flags.items())
    )


def _by_run_id(daily: DataFrame, names: Sequence[str]) -> DataFrame:
    """Counts keyed by run id, which each flag numbers on its own."""
    long = daily.unpivot(["location", "date"], list(names), "flag", "n").where("n > 0")
    seen = long.select("flag", "location").distinct()
    few = has_at_most(seen, SMALL_ROWS)
    numbered = number_rows(written(seen, "flag-locations"), ["location"], within=["flag"], name="Number")
    numbered = numbered.withColumn("Number", F.col("Number").cast("int"))
    return (
        long.join(F.broadcast(numbered) if few else numbered, ["flag", "location"])
        .groupBy(F.col("Number").alias("location"), "date")
        .agg(*(F.sum(F.when(F.col("flag") == name, F.col("n")).otherwise(0)).alias(name) for name in names))
    )
