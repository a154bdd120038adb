"""Weather folded into blocks of 32 days, and lookups into them.

One row per postcode and block, holding the values of its days in an array, is
the form in which births meet the weather. Compared with one row per day it has a
thirtieth of the join keys and fits a broadcast much longer, and a hot postcode
still spreads over as many keys as its history has blocks.

Running totals are kept *before* each day, so that the total over the closed
interval [a, b] is ``before(b + 1) - before(a)``: two lookups instead of a join
with every day of the interval. They have two levels: what lies before a block, and what lies
before a day within it. Only blocks that hold weather exist; a day between two blocks is
looked up at the end of the earlier one, found by bisection of the postcode's list of blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climagest.sources.shared import SMALL_ROWS, broadcast_limit, written

_BLOCK_BITS = 5
BLOCK_DAYS = 1 << _BLOCK_BITS

REACH = 4  # blocks per row of folded exposure

SALTS = 16
_MAX_INT = 2**31 - 1


def block_of(date: Column) -> Column:
    return F.shiftright(F.unix_date(date), _BLOCK_BITS)


def place_in_block(date: Column) -> Column:
    """Position of the day in its block, from 0. Also right before 1970."""
    return F.unix_date(date).bitwiseAND(F.lit(BLOCK_DAYS - 1))


def first_day_of_block(block: Column) -> Column:
    return F.date_from_unix_date(F.shiftleft(block, _BLOCK_BITS))


@dataclass(frozen=True)
class Blocks:
    """Folded weather.

    ``frame``: location, block and the arrays, stored. ``exposure`` has one entry
    per day for ``reach`` blocks from this one on. Running totals have ``ord``, the number of the block
    within its postcode, ``before`` with one entry per name, and ``totals`` with ``len(names)``
    entries per day of the block and once more for its end.
    ``starts``: location and the blocks it has, in order; ``most`` is the length of the longest list.
    ``few``: the postcodes are checked to be few.
    ``fits``: the folded table is checked to be small enough for a broadcast.
    """

    frame: DataFrame
    names: tuple[str, ...]
    few: bool
    fits: bool
    reach: int = 1
    starts: DataFrame | None = None
    most: int = 0


@dataclass(frozen=True)
class _Size:
    locations: int
    blocks: int
    top: int
    most: int


def _size(daily: DataFrame, weight: Column) -> _Size:
    """Number of postcodes and of blocks with weather, and the largest total weight and number of blocks of a postcode."""
    row = (
        daily.groupBy("location", block_of(F.col("date")).alias("block"))
        .agg(F.sum(weight).alias("weight"))
        .groupBy("location")
        .agg(F.count("*").alias("blocks"), F.sum("weight").alias("weight"))
        .agg(
            F.count("*").alias("locations"),
            F.sum("blocks").alias("blocks"),
            F.max("weight").alias("top"),
            F.max("blocks").alias("most"),
        )
        .first()
    )
    return _Size(row["locations"], row["blocks"] or 0, row["top"] or 0, row["most"] or 0)


def _limit(frame: DataFrame, given: int | None) -> int:
    return broadcast_limit(frame.sparkSession) if given is None else given


def fold_exposure(daily: DataFrame, reach: int = REACH, broadcast_bytes: int | None = None) -> Blocks:
    """Fold location, date, exposure (unique days); a missing day is null in its array.

    Every row holds ``reach`` blocks, its own and the following ones, so that a
    pregnancy is covered by a few lookups. Each day is thus stored ``reach`` times.
    """
    stored = written(daily.where(F.col("exposure").isNotNull()), "daily")
    length = reach * BLOCK_DAYS
    by_place = F.map_from_entries(F.collect_list(F.struct("_place", "exposure")))
    frame = (
        stored.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach - 1))).alias("_behind"))
        .select(
            "location",
            (block_of(F.col("date")) - F.col("_behind")).alias("block"),
            (place_in_block(F.col("date")) + F.col("_behind") * BLOCK_DAYS).alias("_place"),
            "exposure",
        )
        .groupBy("location", "block")
        .agg(by_place.alias("_days"))
        .select(
            "location",
            "block",
            F.transform(
                F.sequence(F.lit(0), F.lit(length - 1)), lambda place: F.try_element_at("_days", place)
            ).alias("exposure"),
        )
    )
    frame = written(frame, "blocks")
    fits = frame.count() * (96 + 8 * length) <= _limit(frame, broadcast_bytes)
    return Blocks(frame, (), _size(stored, F.lit(1)).locations <= SMALL_ROWS, fits, reach)


def fold_running_totals(
    daily: DataFrame,
    totals: Mapping[str, Column],
    counts: bool = True,
    exposure: bool = False,
    broadcast_bytes: int | None = None,
) -> Blocks:
    """Fold running totals over the days of each postcode.

    ``daily``: stored table of location, date (unique days) and more. ``totals``
    maps a name to what is added up; the array holds the total over all earlier
    days. ``counts`` says that all of them are whole and not negative; they are
    then kept as int where that is checked to be enough, and as double otherwise.
    ``exposure`` folds the exposure itself, too.

    Days are summed within their block; one row per block and postcode then shares a window. Nothing is made for days or
    blocks without weather, so a day far off adds one block.
    """
    largest = F.greatest(F.lit(0), *totals.values()) if counts else F.lit(1)
    size = _size(daily, largest)
    element = ("int" if size.top <= _MAX_INT else "bigint") if counts else "double"
    kept = ["exposure"] if exposure else []
    width = len(totals)

    in_block = Window.partitionBy("location", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = daily.select(
        "location",
        block_of(F.col("date")).alias("block"),
        place_in_block(F.col("date")).alias("place"),
        *(c.alias(f"_{k}") for k, c in enumerate(totals.values())),
        *kept,
    )
    upto = F.array(*(F.coalesce(F.sum(f"_{k}").over(in_block), F.lit(0)).cast(element) for k in range(width)))
    days = F.array_sort(F.collect_list(F.struct("place", "upto", *kept)))
    gathered = (
        placed.select("location", "block", "place", upto.alias("upto"), *kept).groupBy("location", "block").agg(days.alias("_days"))
    )
    of_location = Window.partitionBy("location").orderBy("block")
    earlier = of_location.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.element_at(F.col("_days").getField("upto"), -1)
    before = [F.coalesce(F.sum(F.get(whole, F.lit(k))).over(earlier), F.lit(0)).cast(element) for k in range(width)]
    places, nothing = F.col("_days").getField("place"), F.array_repeat(F.lit(0).cast(element), width)
    # for each day, and for the end of the block, how many of its days with weather come earlier
    passed = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_DAYS)), lambda p: F.size(F.filter(places, lambda q: q < p)))
    inside = F.transform(passed, lambda i: F.coalesce(F.get(F.col("_days").getField("upto"), i - 1), nothing))
    in_place = F.transform(
        F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1)),
        lambda p: F.get(F.col("_days").getField("exposure"), (F.array_position(places, p) - 1).cast("int")),
    )
    frame = gathered.select(
        "location",
        "block",
        (F.row_number().over(of_location) - 1).alias("ord"),
        F.array(*before).alias("before"),
        F.flatten(inside).alias("totals"),
        *(in_place.alias(k) for k in kept),
    )
    frame = written(frame, "blocks")
    starts = frame.groupBy("location").agg(F.sort_array(F.collect_list("block")).alias("_starts"))
    limit = _limit(frame, broadcast_bytes)
    few = size.locations <= SMALL_ROWS
    lists_fit = few and size.blocks * 4 + size.locations * 64 <= _limit(frame, None)
    row_bytes = 96 + (4 if element == "int" else 8) * width * (BLOCK_DAYS + 2) + 8 * len(kept) * BLOCK_DAYS
    return Blocks(
        frame, tuple(totals), few, size.blocks * row_bytes <= limit, 1, F.broadcast(starts) if lists_fit else starts, size.most
    )


def join_blocks(
    df: DataFrame, blocks: Blocks, key: str, block: Column, arrays: Mapping[str, str], on: str = "block"
) -> DataFrame:
    """Add ``arrays`` (array of the blocks -> column) of the block; null where there is none.

    ``on`` says whether ``block`` is a block of the calendar or its number within the postcode ("ord").
    If the blocks fit a broadcast, ``df`` is not moved at all. Otherwise both
    sides are shuffled on postcode, block and a salt taken from the whole row of
    ``df``, so that a block wanted by very many rows is served by several tasks;
    what a salt cannot split (copies of one row) adaptive execution does.
    """
    side = blocks.frame.select(
        F.col("location").alias("_location"),
        F.col(on).alias("_block"),
        *(F.col(array).alias(name) for array, name in arrays.items()),
    )
    match = (F.col(key) == F.col("_location")) & (block == F.col("_block"))
    if blocks.fits:
        return df.join(F.broadcast(side), match, "left").drop("_location", "_block")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    side = side.withColumn("_side_salt", F.explode(F.array(*(F.lit(s) for s in range(SALTS)))))
    joined = salted.join(side.hint("merge"), match & (F.col("_salt") == F.col("_side_salt")), "left")
    return joined.drop("_location", "_block", "_salt", "_side_salt")


def exposure_on(df: DataFrame, blocks: Blocks, date: str, name: str = "exposure", key: str = "location") -> DataFrame:
    """Add the exposure on the day in column ``date``."""
    found = join_blocks(df, blocks, key, block_of(F.col(date)), {"exposure": "_values"})
    return found.select(*df.columns, F.get("_values", place_in_block(F.col(date))).alias(name))


def totals_at(df: DataFrame, blocks: Blocks, dates: Sequence[str], key: str = "location") -> DataFrame:
    """Add ``_at_<column>`` for each date column: the totals of all names before that day, null before the first block."""
    width, steps = len(blocks.names), [1 << k for k in reversed(range(max(1, blocks.most.bit_length())))]
    starts = blocks.starts.withColumnRenamed("location", "_location")
    rows = df.join(starts, F.col(key) == F.col("_location"), "left").drop("_location")

    def last_block(day: Column) -> Column:
        """Number of the last block that does not begin after the day's, by bisection; -1 if there is none."""
        return F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(-1),
            lambda at, step: F.when(F.get("_starts", at + step) <= block_of(day), at + step).otherwise(at),
        )

    rows = rows.withColumns({f"_ord_{date}": last_block(F.col(date)) for date in dates})
    for date in dates:
        there = F.get("_starts", F.col(f"_ord_{date}")) == block_of(F.col(date))
        rows = rows.withColumn(f"_place_{date}", F.when(there, place_in_block(F.col(date))).otherwise(BLOCK_DAYS))
    rows = rows.drop("_starts")
    for date in dates:
        rows = join_blocks(rows, blocks, key, F.col(f"_ord_{date}"), {"totals": "_totals", "before": "_before"}, "ord")
        inside = F.slice("_totals", F.col(f"_place_{date}") * width + 1, F.lit(width))
        found = F.zip_with("_before", inside, lambda before, within: before + within)
        rows = rows.withColumn(f"_at_{date}", found).drop("_totals", "_before", f"_ord_{date}", f"_place_{date}")
    return rows


def totals_between(
    df: DataFrame, blocks: Blocks, start: Column, stop: Column, key: str = "location"
) -> DataFrame:
    """Add one column per name of the blocks: its total from ``start`` up to the day before ``stop``."""
    rows = totals_at(df.withColumns({"_from": start, "_to": stop}), blocks, ["_from", "_to"], key)
    nothing = F.array_repeat(F.lit(0), len(blocks.names))
    ends = (F.coalesce(f"_at_{end}", nothing) for end in ("_to", "_from"))
    rows = rows.withColumn("_total", F.zip_with(*ends, lambda to, since: to - since))
    return rows.selectExpr(*df.columns, *(f"_total[{k}] AS {name}" for k, name in enumerate(blocks.names)))
