"""Trees of (id, parent): closure, inheritance, roll-up and common ancestors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.storage import materialize


def closure(tree: DataFrame) -> DataFrame:
    """id, ancestor and distance (0 for itself) at any depth, by doubling: each step joins paths of up to twice the length.

    Steps are written out, so none is computed twice, and joined by sorting, for their files are much smaller than their
    rows. ValueError if a node is its own ancestor.
    """
    up = tree.where("parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    steps = [materialize(up, "paths")]
    reach = 1
    while True:
        if not steps[-1].where("id = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        far = steps[-1].where(F.col("distance") == reach).select("id", F.col("ancestor").alias("via"))
        paths = reduce(DataFrame.unionByName, steps)
        more = far.join(paths.select(F.col("id").alias("via"), "ancestor", F.col("distance").alias("d")).hint("merge"), "via").select("id", "ancestor", (F.col("d") + reach).alias("distance"))
        more = materialize(more, "paths")
        if more.isEmpty():
            return tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).unionByName(paths)
        steps.append(more)
        reach *= 2


def inherit(tree: DataFrame, local: DataFrame, default: str) -> DataFrame:
    """id, value and source: the value set at the nearest ancestor or at the node itself; else the default."""
    found = closure(tree).join(local.withColumnRenamed("id", "ancestor"), "ancestor").groupBy("id").agg(F.min_by(F.struct("value", F.col("ancestor").alias("source")), "distance").alias("best"))
    return tree.select("id").join(found, "id", "left").select("id", F.coalesce("best.value", F.lit(default)).alias("value"), F.coalesce("best.source", F.lit("default")).alias("source"))


def roll_up(tree: DataFrame, amounts: DataFrame, **sums: str) -> DataFrame:
    """Sums of amounts of every node and all below it; amounts are added up by node before they meet the closure."""
    own = amounts.groupBy("id").agg(*(F.expr(e).alias(n) for n, e in sums.items()))
    return closure(tree).join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(*(F.sum(n).alias(n) for n in sums))


def common_ancestor(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b and their lowest common ancestor, itself possible."""
    up = closure(tree)
    left = pairs.join(up.select(F.col("id").alias("a"), "ancestor", F.col("distance").alias("da")), "a")
    return left.join(up.select(F.col("id").alias("b"), "ancestor"), ["b", "ancestor"]).groupBy("a", "b").agg(F.min_by("ancestor", "da").alias("ancestor"))
