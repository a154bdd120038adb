"""Row numbers and run ids over data sorted across all tasks.

``row_number`` over one big window puts the whole window into one task. Here the
rows are range-partitioned and sorted, each task numbers its own stretch, and the
small table of stretch sizes supplies what came before. That also holds when one
postcode owns most rows, since its rows spread over as many stretches as needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from climagest.sources.shared import small, written

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, position below


def placed_in_order(df: DataFrame, order_by: Sequence[str], unique: bool = False) -> DataFrame:
    """Rows with ``_part`` and ``_pos``, their place in the order of ``order_by``.

    Stored before use: range bounds come from sampling, so a second evaluation
    could cut the stretches elsewhere. Rows equal in ``order_by`` come in the order of a hash of the whole
    row, which does not depend on how the input was divided among tasks; rows equal in
    everything are told apart by their position, so that a large group of copies can be cut, too.
    ``unique`` says that no two rows are equal in ``order_by``.
    """
    stretches = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(order_by) if unique else [*order_by, "_same", "_tie"]
    hashed = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tied = df if unique else df.withColumns({"_same": F.xxhash64(*hashed), "_tie": F.monotonically_increasing_id()})
    placed = (
        tied.repartitionByRange(stretches, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_place", _POSITION_BITS).cast("int").alias("_part"),
            F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_pos"),
        )
    )
    return written(placed, "placed")


def totals_before(placed: DataFrame, within: Sequence[str], total: Column) -> DataFrame:
    """Per group and stretch, the ``total`` of the group's earlier stretches as ``_before``.

    At most one row per stretch plus one per group.
    """
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        placed.groupBy(*within, "_part")
        .agg(total.alias("_total"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .select(*within, "_part", "_before", "_first")
    )
    return small(table)


def number_rows(
    df: DataFrame, order_by: Sequence[str], within: Sequence[str] = (), name: str = "row", ties: Sequence[str] = ()
) -> DataFrame:
    """Number rows from 1 in the order of ``order_by``, restarting in each ``within`` group.

    The same rows get the same numbers however the input is divided. ``ties`` names columns that order what
    ``order_by`` leaves equal, such as ``sources.readers.PLACE`` for the order of the input files.
    """
    placed = placed_in_order(df, list(dict.fromkeys([*within, *order_by, *ties])))
    offsets = totals_before(placed, within, F.count("*"))
    number = F.col("_before") + F.col("_pos") - F.col("_first") + 1
    return placed.join(offsets, [*within, "_part"]).select(*df.columns, number.alias(name))


def number_values(df: DataFrame, column: str, name: str = "Number", few: bool = False) -> DataFrame:
    """The distinct values of ``column`` and their rank.

    For rows sorted by ``column`` this rank is the run id of the row. ``few`` says
    that the number of values is known to be small, so that one task may rank them.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    if not few:
        return number_rows(distinct, [column], name=name).withColumn(name, F.col(name).cast("int"))
    return distinct.withColumn(name, F.row_number().over(Window.orderBy(column)))


def run_ids(
    df: DataFrame, column: str, order_by: Sequence[str], name: str = "Number", within: Sequence[str] = ()
) -> DataFrame:
    """Run id in the order of ``order_by``: it grows whenever ``column`` changes, and starts anew in each ``within`` group.

    A value that comes back after another one is a new run. Also adds ``<column>_step``, the difference to the row before.
    """
    placed = placed_in_order(df, list(dict.fromkeys([*within, *order_by])))
    in_part = Window.partitionBy("_part", *within).orderBy("_pos")
    # last value of the nearest earlier stretch, for the first row of a stretch
    lasts = placed.groupBy(*within, "_part").agg(F.max_by(column, "_pos").alias("_last"), F.min("_pos").alias("_begin"))
    order = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part")
    previous = small(lasts.withColumn("_prior", F.lag("_last").over(order)).drop("_last"))
    before = F.when(F.col("_pos") == F.col("_begin"), F.col("_prior")).otherwise(F.lag(column).over(in_part))
    step = F.col(column) - F.col("_before_value")
    stepped = (
        placed.join(previous, [*within, "_part"])
        .withColumn("_before_value", before)
        .withColumn(f"{column}_step", step)
        .withColumn("_change", F.when(F.col(f"{column}_step") != 0, 1).otherwise(0))
    )
    earlier = totals_before(stepped, within, F.sum("_change"))
    through_row = in_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = 1 + F.col("_before") + F.sum("_change").over(through_row)
    return (
        stepped.join(earlier.drop("_first"), [*within, "_part"])
        .withColumn(name, run.cast("int"))
        .select(*df.columns, f"{column}_step", name)
    )
