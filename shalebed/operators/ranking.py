"""Places of all rows in one order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.storage import materialize


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a long column of places from 1 on in an order; rows that are equal in it have places in no certain order.

    Rows are dealt by ranges of the order and sorted there; a place is the row's in its range plus the sizes of the
    ranges before, of which there are as many as partitions.
    """
    inside = F.monotonically_increasing_id()  # counts from 0 in each partition, whose number begins at bit 33
    dealt = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", inside), "ranges")
    part = F.shiftright("_i", 33)
    sizes = dealt.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    placed = dealt.withColumn("_p", part).join(F.broadcast(before), "_p")
    return placed.withColumn(name, F.col("_before") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_i", "_before")
