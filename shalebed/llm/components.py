"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """u with the least of its neighbours and itself; the partial minima are taken before the shuffle."""
    return materialize(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return materialize(both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(down)
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(joined.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Columns id and component for every id in edges (u, v long); component is the least id reachable.

    Self links and repeated links are ignored, as are rows with a null end; no edges give no rows. Every step is a
    pre-aggregated minimum and a join whose sides Spark can split, so one node may hold any share of the edges.
    """
    now = materialize(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    sign = _sign(now)
    while True:
        now = _small(_large(now))
        sign, last = _sign(now), sign
        if sign == last:
            break
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
