"""Exact order statistics by selection: no sort of the values and no state per group.

A double's bits, turned so that they sort like the value, are read in digits from the highest on. Each round counts
values by the next digit, inside the prefixes that hold a wanted rank, and goes on with the digit the
rank falls on. Six rounds settle all 64 bits, whatever the distribution. The counts are combined in each task first, so
a round sends a few thousand numbers per group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climagest.sources.shared import small, written

DIGIT_BITS = 11
_SIGN, _REST = -(2**63), 2**63 - 1


def ordered_bits(value: Column) -> Column:
    """Bits of a double such that, taken as an unsigned number, they sort like the value. Both zeros are one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(_SIGN)))


def bits_to_double(bits: Column) -> Column:
    """Undoes ``ordered_bits``."""
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(bits))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _shifts() -> list[int]:
    return [max(0, 64 - DIGIT_BITS * k) for k in range(1, -(-64 // DIGIT_BITS) + 1)]


def values_at_ranks(values: DataFrame, ranks: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``ranks`` (``keys`` and ``rank``, from 0) with the value of that rank among the values of ``column`` as ``value``.

    Nulls are left out; there is no NaN. A rank beyond the number of values gives no row.
    """
    rows = values.where(F.col(column).isNotNull()).select(*keys, ordered_bits(F.col(column)).alias("_bits"))
    rows = written(rows, "bits")
    wanted = written(ranks.select(*keys, "rank", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below")), "ranks")
    before = None
    for shift in _shifts():
        digits = rows.select(*keys, _upper("_bits", before).alias("_prefix"), F.shiftrightunsigned("_bits", shift).alias("_digit"))
        held = digits.join(small(wanted.select(*keys, "_prefix").distinct()), [*keys, "_prefix"], "left_semi")
        counts = held.groupBy(*keys, "_prefix", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy(*keys, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        place = F.col("rank") - F.col("_below") - F.col("_earlier")
        met = counts.join(small(wanted), [*keys, "_prefix"]).where((place >= 0) & (place < F.col("_n")))
        below = F.col("_below") + F.col("_earlier")
        wanted = written(met.select(*keys, "rank", F.col("_digit").alias("_prefix"), below.alias("_below")), "ranks")
        before = shift
    return wanted.select(*keys, "rank", bits_to_double(F.col("_prefix")).alias("value"))


def _upper(bits: str, shift: int | None) -> Column:
    return F.lit(0).cast("long") if shift is None else F.shiftrightunsigned(bits, shift)
