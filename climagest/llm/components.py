"""Connected components by alternating large and small stars, as joins and grouped minima.

No neighbour list is gathered anywhere: a node with very many neighbours costs
partial minima and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from climagest.sources.shared import written


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), mark).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    others = edges.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return low.select("u", F.col("low").alias("v")).union(others).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)``: each node of a component of more than one, save the smallest, with the smallest.

    ``edges`` has long columns ``u`` and ``v``; loops, nulls and repeats are ignored.
    Every round is written to shared storage, so lineage stays short and a lost
    executor costs one round. Rounds grow with the logarithm of the size.
    """
    now = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        now = written(_small_star(_large_star(now)), "edges")
        last, state = state, _state(now)
        if state == last:
            break
    return now
