"""As-of joins: the last, the first or the nearest row of another table in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, how: str, width: int | None = None) -> DataFrame:
    """left with `at_<how>` and `value_<how>` of right by keys: floor (at or before), ceiling (at or after).

    Both tables are swept once in time order within a key; of rows of right at one time the greatest value counts. With
    width, a key's sweep is split into buckets of so much time, so a hot key isn't one task: what right has at the edge
    of a bucket is carried into the others, one row for each key and bucket.
    """
    found = right.groupBy(*keys, at).agg(F.max(value).alias("_v"))
    first, second = (0, 1) if how == "floor" else (1, 0)
    a = found.select(*keys, F.col(at).alias("_t"), F.lit(first).alias("_side"), F.struct(F.col(at).alias("t"), F.col("_v").alias("v")).alias("_hit"))
    b = left.select(*keys, F.col(at).alias("_t"), F.lit(second).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True)
    parts = list(keys)
    if width is not None:
        both = both.withColumn("_b", F.floor(F.col("_t") / width))
        nearest_ = F.max if how == "floor" else F.min
        edges = both.groupBy(*keys, "_b").agg(nearest_("_hit").alias("_edge"))
        line = W.partitionBy(*keys).orderBy("_b")
        outside = line.rowsBetween(W.unboundedPreceding, -1) if how == "floor" else line.rowsBetween(1, W.unboundedFollowing)
        pick = F.last if how == "floor" else F.first
        carried = edges.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_b"])), pick("_edge", ignorenulls=True).over(outside).alias("_edge"))
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_b"])))
        both = both.join(carried, same)
        parts.append("_b")
    order = W.partitionBy(*parts).orderBy("_t", "_side")
    hit = F.last("_hit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)) if how == "floor" else F.first("_hit", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    if width is not None:
        hit = F.coalesce(hit, "_edge")
    return both.withColumn("_hit", hit).where("_row is not null").select("_row.*", F.col("_hit.t").alias(f"at_{how}"), F.col("_hit.v").alias(f"value_{how}"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, width: int | None = None) -> DataFrame:
    """left with at_nearest and value_nearest: the closer of floor and ceiling, floor where they are as close."""
    both = asof(asof(left, right, keys, at, value, "floor", width), right, keys, at, value, "ceiling", width)
    down, up = F.col(at) - F.col("at_floor"), F.col("at_ceiling") - F.col(at)
    use_floor = F.col("at_ceiling").isNull() | (F.col("at_floor").isNotNull() & (down <= up))
    return both.select(*left.columns, F.when(use_floor, F.col("at_floor")).otherwise(F.col("at_ceiling")).alias("at_nearest"), F.when(use_floor, F.col("value_floor")).otherwise(F.col("value_ceiling")).alias("value_nearest"))
