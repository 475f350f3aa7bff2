"""Grants along a tree (id, parent): who may do what where, and what still fits under limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.operators.hierarchy import closure


def expand_sets(grants: DataFrame, sets: DataFrame) -> DataFrame:
    """Grants (id, who, scope, perm) with each named set @name replaced by its members; sets has (id, name, perm) and counts where it is defined."""
    named = F.col("perm").startswith("@")
    members = sets.select("id", F.col("name").alias("perm"), F.col("perm").alias("_member"))
    inner = grants.where(named).join(members, ["id", "perm"]).select("id", "who", "scope", F.col("_member").alias("perm"))
    return grants.where(~named).select("id", "who", "scope", "perm").unionByName(inner).distinct()


def allowed(tree: DataFrame, grants: DataFrame, sets: DataFrame, groups: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, who, perm) with allowed.

    A grant at the node itself counts with scope local or both, at an ancestor with scope below or both. It is for a
    user, for a group (groups: who, member_of) or for everyone.
    """
    flat = expand_sets(grants, sets).select(F.col("id").alias("ancestor"), F.col("who").alias("_to"), "scope", "perm")
    asked = requests.select("id", "who", "perm").distinct()
    # The few names of each asking user, then the grants by node, name and permission.
    names = asked.select("who").distinct().select("who", F.explode(F.array("who", F.lit("everyone"))).alias("_to")).unionByName(groups.select("who", F.col("member_of").alias("_to"))).distinct()
    # Requests and paths grow with the tree and are larger than their files tell, so neither is sent to all tasks.
    hits = asked.join(closure(tree).hint("merge"), "id").join(names, "who").join(flat, ["ancestor", "_to", "perm"]).where(F.when(F.col("distance") == 0, F.col("scope").isin("local", "both")).otherwise(F.col("scope").isin("below", "both")))
    return asked.join(hits.select("id", "who", "perm", F.lit(True).alias("allowed")).distinct(), ["id", "who", "perm"], "left").select("id", "who", "perm", F.coalesce("allowed", F.lit(False)).alias("allowed"))


def admit(tree: DataFrame, used: DataFrame, limits: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, amount) with available, the least room left at the node or above it (null without limits), and fits.

    used has (id, amount) of nodes' own use, which counts at all their ancestors; limits has (id, quota).
    """
    up = closure(tree)
    own = used.groupBy("id").agg(F.sum("amount").alias("amount"))
    taken = up.join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("amount").alias("taken"))
    room = limits.join(taken, "id", "left").select(F.col("id").alias("ancestor"), (F.col("quota") - F.coalesce("taken", F.lit(0))).alias("room"))
    least = up.join(room, "ancestor").groupBy("id").agg(F.min("room").alias("available"))
    return requests.join(least, "id", "left").select("id", "amount", "available", F.coalesce(F.col("amount") <= F.col("available"), F.lit(True)).alias("fits"))
