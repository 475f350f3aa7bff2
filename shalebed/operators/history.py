"""A log of commands: rows (at, time, kind, who, host, text), kind command, internal or value; at grows with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("at", "time", "kind", "who", "host", "text")


def append(log: DataFrame, new: DataFrame, capacity: int) -> DataFrame:
    """The log with new rows; as a ring it keeps the newest `capacity` bytes of texts, and its very first row for good.

    The greatest place that still fits is found from sums over blocks of places, not by one sorted scan.
    """
    whole = log.select(*COLUMNS).unionByName(new.select(*COLUMNS))
    sized = whole.withColumn("_size", F.octet_length("text"))
    width = 1024
    blocks = sorted(((r["b"], r["s"]) for r in sized.groupBy(F.floor(F.col("at") / width).alias("b")).agg(F.sum("_size").alias("s")).collect()), reverse=True)  # one row for each 1,024 places
    left, cut = capacity, None
    for b, s in blocks:
        if s > left:
            inside = sorted(((r["at"], r["_size"]) for r in sized.where(F.floor(F.col("at") / width) == b).select("at", "_size").collect()), reverse=True)
            cut = (b + 1) * width
            for at, size in inside:
                if size > left:
                    break
                left, cut = left - size, at
            break
        left -= s
    if cut is None:
        return whole
    first = whole.agg(F.min("at").alias("_first"))
    return whole.join(F.broadcast(first)).where((F.col("at") >= cut) | (F.col("at") == F.col("_first"))).drop("_first")


def page(log: DataFrame, after: int, n: int) -> DataFrame:
    """The next n rows after a place."""
    return log.where(F.col("at") > after).orderBy("at").limit(n)


def shown(internal: bool = False) -> Column:
    """Which rows a listing shows: commands, and with internal all."""
    return F.lit(internal) | (F.col("kind") == "command")


def line(long: bool = False) -> Column:
    """A row as text: the time, what was done, and with long by whom and where."""
    what = F.when(F.col("kind") == "command", F.col("text")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("text")))
    text = F.concat(F.date_format("time", "yyyy-MM-dd.HH:mm:ss"), F.lit(" "), what)
    return F.concat(text, F.lit(" [user "), F.col("who"), F.lit(" on "), F.col("host"), F.lit("]")) if long else text
