"""Wide day tables, reshaping, and work on whole postcodes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from climagest.functions.columns import day_names, named_like
from climagest.operators.blocks import BLOCK_DAYS, Blocks, block_of, join_blocks, place_in_block
from climagest.operators.numbering import number_rows
from climagest.operators.spine import BIRTH_ORDER
from climagest.sources.shared import spread, written

WIDE_KEYS = ("location", "RFA_ID", "admd", "pre", "tr3_end")

_STRETCH_BITS = 4
#: Day columns handled together where rows are made wide or long; Spark compiles steps of at most a hundred columns.
STRETCH = 1 << _STRETCH_BITS


def exposure_wide(
    births: DataFrame, blocks: Blocks, n_days: int, first: int = 1, keep: Sequence[str] = WIDE_KEYS, dealt: bool = False
) -> DataFrame:
    """One row per birth with the columns ``keep`` and Day_``first`` .. Day_``n_days``.

    Days after delivery are null. A birth's days lie in a few consecutive blocks.
    With broadcast blocks these are looked up one after the other and laid end to
    end, without moving births again once they are laid out evenly over tasks by ``BIRTH_ORDER``; with ``dealt``, the caller has
    done that, and their order stays. Otherwise births are numbered, split by block, joined once and put together.
    """
    needed = list(dict.fromkeys([*keep, "location", "RFA_ID", "pre", "tr3_end"]))
    begun = births.select(*needed, F.date_add("pre", first - 1).alias("_begin"))
    length = n_days - first + 1
    # as many rows of blocks as the range touches when it begins on a block's last day
    touched = math.ceil((BLOCK_DAYS - 1 + length) / (blocks.reach * BLOCK_DAYS))
    if blocks.fits:
        rows = begun if dealt else spread(begun, length, BIRTH_ORDER)
        for k in range(touched):
            block = block_of(F.col("_begin")) + k * blocks.reach
            rows = join_blocks(rows, blocks, "location", block, {"exposure": f"_block_{k}"})
        rows = rows.withColumn("_days", F.concat(*(F.coalesce(f"_block_{k}", _missing(blocks)) for k in range(touched))))
    else:
        rows = _gathered(begun, blocks, touched)
    # the days from the first one until delivery, cut out once
    last = F.date_diff("tr3_end", "_begin")
    own = F.slice("_days", place_in_block(F.col("_begin")) + 1, F.least(F.lit(length), last + 1))
    rows = rows.select(*keep, F.when(last >= 0, own).alias("_own"))
    return rows.select(*keep, *(F.get("_own", F.lit(k)).alias(name) for k, name in enumerate(day_names(first, n_days))))


def _missing(blocks: Blocks) -> Column:
    return F.array_repeat(F.lit(None).cast("double"), blocks.reach * BLOCK_DAYS)


def _gathered(begun: DataFrame, blocks: Blocks, touched: int) -> DataFrame:
    numbered = number_rows(begun, ["location", "RFA_ID", "pre", "tr3_end"], name="_birth")
    split = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(touched - 1))).alias("_k"))
    block = block_of(F.col("_begin")) + F.col("_k") * blocks.reach
    met = join_blocks(split, blocks, "location", block, {"exposure": "_piece"})
    # at most ``touched`` arrays per birth are collected
    pieces = F.array_sort(F.collect_list(F.struct("_k", F.coalesce("_piece", _missing(blocks)).alias("_piece"))))
    return (
        met.groupBy("_birth", *begun.columns)
        .agg(pieces.alias("_pieces"))
        .withColumn("_days", F.flatten(F.col("_pieces").getField("_piece")))
    )


def pivot_days(long: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Long day rows to Day_ columns. ``keys`` identify a birth; of repeated days the largest exposure counts.

    Days are first gathered by stretches of ``STRETCH`` days, whose few columns Spark compiles, and the stretches of a birth then put
    next to each other. Where the long rows come divided among tasks by some of the keys, as from ``day_exposure`` with ``whole``,
    neither step moves them. The column names are given, which saves the pass that would look for them.
    """
    days = day_names(first, last)
    places = range(min(STRETCH, len(days)))
    at = F.when(F.col("day_idx").between(first, last), F.col("day_idx") - first).cast("int")
    stretch, place = F.shiftright(at, _STRETCH_BITS), at.bitwiseAND(F.lit(STRETCH - 1))
    placed = long.select(*keys, stretch.alias("_stretch"), place.alias("_at"), "exposure")
    # births are put together in the order in which they lie
    order = sorted(keys, key=lambda key: BIRTH_ORDER.index(key) if key in BIRTH_ORDER else len(BIRTH_ORDER))
    stretches = placed.groupBy(*order, "_stretch").agg(*(F.max(F.when(F.col("_at") == k, F.col("exposure"))).alias(f"_{k}") for k in places))
    whole = stretches.select(*keys, "_stretch", F.array(*(f"_{k}" for k in places)).alias("_values"))
    number = math.ceil(len(days) / STRETCH)
    births = whole.groupBy(*order).agg(*(F.max(F.when(F.col("_stretch") == k, F.col("_values"))).alias(f"_{k}") for k in range(number)))
    return births.select(*keys, *(F.get(f"_{k // STRETCH}", F.lit(k % STRETCH)).alias(name) for k, name in enumerate(days)))


def unpivot_days(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Day_ columns back to rows of ``name`` and ``value``.

    The days of a row are laid into one array first. That step reads hundreds of columns and cannot be compiled as a whole, but
    has few rows; the next, which makes a row of each day, has few columns and is. (An array of one array keeps them apart.)
    """
    days = named_like(wide, "Day_")
    if not days:
        return wide.unpivot(list(keys), days, "name", "value")
    rows = wide.select(*keys, F.explode(F.array(F.array(*days))).alias("_values"))
    rows = rows.select(*keys, F.posexplode("_values").alias("_at", "value"))
    return rows.select(*keys, F.get(F.array(*(F.lit(day) for day in days)), F.col("_at")).alias("name"), "value")


def split_groups(df: DataFrame, key: str, order_by: Sequence[str], rows: int) -> DataFrame:
    """Add ``piece``: consecutive rows of a group share it, at most ``rows`` of them."""
    numbered = number_rows(df, order_by, within=[key], name="_row")
    return numbered.withColumn("piece", F.floor((F.col("_row") - 1) / rows).cast("int"))


def nest(df: DataFrame, key: str, order_by: Sequence[str], rows: int) -> DataFrame:
    """Rows of each group as arrays of structs under ``data``, in the order of ``order_by``.

    An array has to fit one task, so the caller states how many rows it may hold. A group
    is laid out in arrays of ``rows`` rows, numbered by ``piece`` from 0; only the last may be shorter.
    """
    inner = [c for c in df.columns if c != key]
    ordered = F.array_sort(F.collect_list(F.struct("_row", F.struct(*inner).alias("_data"))))
    return (
        split_groups(df, key, order_by, rows)
        .groupBy(key, "piece")
        .agg(ordered.getField("_data").alias("data"))
    )


def unnest(nested: DataFrame, column: str = "data") -> DataFrame:
    """Undo ``nest``."""
    rest = [c for c in nested.columns if c != column]
    return nested.select(*rest, F.inline(column))


def stack_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Append tables by column name; a column a table lacks is null there."""
    stacked = None
    for table in tables:
        stacked = table if stacked is None else stacked.unionByName(table, allowMissingColumns=True)
    if stacked is None:
        raise ValueError("no tables given")
    return stacked


def map_groups(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    partial: Callable,
    partial_schema: str,
    merge: Callable,
    schema: str,
    rows: int = 100_000,
    combine: Callable | None = None,
    fan: int = 64,
) -> DataFrame:
    """A calculation on the ordered rows of each group that built-in functions cannot express.

    ``partial`` gets consecutive rows of a group as a pandas frame, at most ``rows`` at a time, and
    gives what has to be known of them (``partial_schema``). ``merge`` gets all that ``partial`` gave for
    a group, in order and with its ``piece``, and gives the group's result (``schema``, with ``key``). No task
    holds the rows of a whole group, and if ``merge`` puts pieces together correctly the result is
    the same for every ``rows``, so each group has one result whatever its size.

    ``combine`` gets what is known of up to ``fan`` neighbouring pieces, in order, and gives what has to be known of them
    together, in the same columns. With it, pieces are put together round by round until ``merge`` gets at most
    ``fan`` of them, so no task reads more than that of a group.
    """
    pieces = split_groups(df, key, order_by, rows).drop("_row")

    def one(rows_of_piece: pd.DataFrame) -> pd.DataFrame:
        place = rows_of_piece[[key, "piece"]].iloc[0]
        return partial(rows_of_piece.drop(columns="piece")).assign(**{key: place[key], "piece": place["piece"]})

    fields = StructType.fromDDL(partial_schema)
    known = StructType([pieces.schema[key], pieces.schema["piece"], *(f for f in fields if f.name != key)])
    partials = pieces.groupBy(key, "piece").applyInPandas(lambda p: one(p)[known.names], known)
    if combine is not None:

        def together(near: pd.DataFrame) -> pd.DataFrame:
            place = near[[key, "_round"]].iloc[0]
            whole = combine(near.sort_values("piece").drop(columns="_round"))
            return whole.assign(**{key: place[key], "piece": place["_round"]})[known.names]

        partials = written(partials, "partials")
        top = partials.agg(F.max("piece")).first()[0] or 0
        while top >= fan:
            near = partials.withColumn("_round", F.floor(F.col("piece") / fan).cast("int"))
            partials = near.groupBy(key, "_round").applyInPandas(together, known)
            top //= fan
    return partials.groupBy(key).applyInPandas(lambda p: merge(p.sort_values("piece")), schema)
