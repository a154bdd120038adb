"""Mixing sources to target weights.

A token budget goes down a tree (domain, language, source). At each node it is shared out by
weight among the children; a child that has fewer tokens than its share, even if repeated as
often as allowed, gets what it has, and its shortage goes to its siblings. Only when all
of them are full does it reach the node's own siblings, since no node is given more than its
leaves can hold.

A leaf repeats its documents for as many whole epochs as its target holds, then takes
those that come first in an order drawn from the seed and the epoch's number, as long as their tokens fit. That
prefix is described by one cutoff per leaf: tokens are summed per leaf and slice of the order, and only the one
slice in which the target is reached is looked at document by document. Texts are never moved.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from climagest.llm.toxicity import free_name
from climagest.sources.shared import settled, small, written

LEVELS = ("domain", "language", "source")
WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of an order key that make a slice: 4,096 slices per leaf.
SLICE = 3


@dataclass(frozen=True)
class Mixture:
    """Whole-number weights by level and node name (others: 1), the budget in hundredths of all tokens, epochs and seed."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    percent: int = 100
    epochs: int = 2
    seed: int = 7


#: Domains by the last sign of the source's name; others are "forum".
DOMAINS = {"web": "0123", "reference": "456"}
MIXTURE = Mixture(
    {"domain": {"web": 5, "reference": 3, "forum": 2}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}}
)


def tree(lang: Column, source: Column) -> list[Column]:
    """Names of a document's domain, language and source; null is the empty name."""
    name = F.coalesce(source.cast("string"), F.lit(""))
    domain = F.lit("forum")
    for value, signs in DOMAINS.items():
        domain = F.when(F.right(name, F.lit(1)).isin(*signs), value).otherwise(domain)
    return [domain.alias(LEVELS[0]), F.coalesce(lang.cast("string"), F.lit("")).alias(LEVELS[1]), name.alias(LEVELS[2])]


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds ``target`` to ``nodes`` (``parents``, ``name``, ``cap``, ``weight`` and the parent's target ``given``); all are whole numbers."""
    same = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = same.orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    nodes = nodes.withColumns(
        {"held": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("weight").over(after)}
    ).withColumn("full", F.col("cap") * F.col("open") <= (F.col("given") - F.col("held")) * F.col("weight"))
    part = F.when(F.col("full"), 0).otherwise(F.col("weight"))
    nodes = nodes.withColumns(
        {
            "rest": F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(same),
            "all": F.sum(part).over(same),
            "upto": F.sum(part).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    until = lambda upto: F.expr(f"(rest * ({upto})) div `all`")
    target = F.when(F.col("full"), F.col("cap")).otherwise(until("upto") - until("upto - weight"))
    return nodes.withColumn("target", target).drop("held", "open", "full", "rest", "all", "upto")


def budgets(leaves: DataFrame, mixture: Mixture) -> DataFrame:
    """``LEVELS, leaf_tokens, leaf_target`` from ``LEVELS, leaf_tokens``: one row per leaf of the tree."""
    caps = leaves.withColumn("cap", F.col("leaf_tokens") * mixture.epochs)
    parents: list[str] = []
    for level in LEVELS:
        nodes = caps.groupBy(*parents, level).agg(F.sum("cap").alias("cap"))
        weight = F.lit(1)
        for value, number in mixture.weights.get(level, {}).items():
            weight = F.when(F.col(level) == value, number).otherwise(weight)
        nodes = nodes.withColumn("weight", weight.cast("long"))
        if parents:
            nodes = nodes.join(given, parents)
        else:
            every = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("every", every).withColumn(
                "given", F.least(F.expr(f"every div {mixture.epochs} * {mixture.percent} div 100"), "every")
            )
        parents = [*parents, level]
        given = shared_out(nodes, parents[:-1], level).select(*parents, F.col("target").alias("given"))
    return leaves.join(given.withColumnRenamed("given", "leaf_target"), list(LEVELS))


def cutoffs(sizes: DataFrame, mixture: Mixture) -> DataFrame:
    """Per leaf: its budget, whole epochs, and where the prefix of the last epoch ends.

    ``sizes`` has ``doc_id``, ``LEVELS`` and ``n_tokens``; it is read several times. Documents without words never count.
    """
    sizes = sizes.where("n_tokens > 0")
    leaves = sizes.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    leaves = written(budgets(written(leaves, "leaves"), mixture), "leaves")
    leaves = leaves.withColumns({"whole": F.expr("leaf_target div leaf_tokens"), "rest": F.expr("leaf_target % leaf_tokens")})
    rows = sizes.join(small(leaves), list(LEVELS))
    rows = rows.withColumn("key", order_key(F.col("whole"), F.col("doc_id"), mixture.seed))
    rows = rows.withColumn("slice", F.left("key", F.lit(SLICE)))
    sums = rows.groupBy(*LEVELS, "slice", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS).orderBy("slice")
    edges = sums.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    edges = edges.where("before <= rest and rest < before + n").select(*LEVELS, "slice", "before")
    edges = written(edges, "edges")
    near = rows.join(small(edges), [*LEVELS, "slice"]).groupBy(*LEVELS, "slice", "key", "before", "rest").agg(F.sum("n_tokens").alias("n"))
    filled = F.col("before") + F.sum("n").over(Window.partitionBy(*LEVELS, "slice").orderBy("key"))
    fits = near.withColumn("filled", filled).where("filled <= rest").groupBy(*LEVELS).agg(F.max("key").alias("cutoff"))
    # a key is longer than its slice, so where no document of the slice fits, the slice alone is the cutoff
    found = leaves.join(edges, list(LEVELS)).join(fits, list(LEVELS), "left")
    return found.withColumn("cutoff", F.coalesce("cutoff", "slice")).drop("slice", "before")


def copies(doc_id: Column, n_tokens: Column, mixture: Mixture) -> Column:
    """How often a document is taken, from the columns of ``cutoffs``."""
    last = order_key(F.col("whole"), doc_id, mixture.seed) <= F.col("cutoff")
    taken = F.when(n_tokens > 0, F.col("whole") + last.cast("long"))
    return F.coalesce(taken, F.lit(0)).cast("long")


def mixture_of(docs: DataFrame, mixture: Mixture = MIXTURE) -> DataFrame:
    """``doc_id, domain, language, source, n_tokens, leaf_tokens, leaf_target, copies`` for every row of ``docs``.

    Tokens are words. ``copies`` is how often the row is taken, 0 for those left out and those
    without words. Null names are the empty name. Rows of a leaf that share an id are taken or left together.
    """
    sizes = docs.select("doc_id", *tree(F.col("lang"), F.col("source")), tokens(F.col("text")).alias("n_tokens"))
    sizes = written(sizes, "sizes")
    found = sizes.join(small(written(cutoffs(sizes, mixture), "cutoffs")), list(LEVELS), "left")
    budget = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("leaf_tokens", "leaf_target")]
    return found.select(
        "doc_id", *LEVELS, "n_tokens", *budget, copies(F.col("doc_id"), F.col("n_tokens"), mixture).alias("copies")
    )


def mixed(docs: DataFrame, mixture: Mixture = MIXTURE) -> DataFrame:
    """``docs`` with each row as often as the mixture takes it, all columns; order is not defined."""
    sizes = docs.select("doc_id", *tree(F.col("lang"), F.col("source")), tokens(F.col("text")).alias("n_tokens"))
    plan = small(settled(docs.sparkSession, lambda: cutoffs(written(sizes, "sizes"), mixture), "cutoffs"))
    row = free_name(docs, "row")
    whole = docs.select(
        F.struct(*(f"`{name}`" for name in docs.columns)).alias(row),
        F.col("doc_id").alias("id of row"),
        tokens(F.col("text")).alias("tokens of row"),
        *tree(F.col("lang"), F.col("source")),
    )
    found = whole.join(plan, list(LEVELS)).select(
        row, F.explode(F.array_repeat(F.lit(0), copies(F.col("id of row"), F.col("tokens of row"), mixture).cast("int")))
    )
    return found.select(*(F.col(row).getField(name).alias(name) for name in docs.columns))
