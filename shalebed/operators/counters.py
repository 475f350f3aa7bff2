"""Counters that many add to: bounds without the exact value, batch sizes, rows of a log by time, unique numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.storage import materialize


def bounds(df: DataFrame, bucket: str, delta: str, borrowed: int) -> DataFrame:
    """lower, upper and exact: each bucket may hold up to `borrowed` either way before it hands its sum on.

    What is handed on are whole borrowed amounts; what a bucket still holds widens the bounds.
    """
    own = df.groupBy(bucket).agg(F.sum(delta).cast("long").alias("s"))
    kept = F.col("s") % borrowed
    sums = own.agg(F.coalesce(F.sum(F.col("s") - kept), F.lit(0)).alias("given"), F.count("*").alias("n"), F.coalesce(F.sum("s"), F.lit(0)).alias("exact"))
    return sums.select((F.col("given") - F.col("n") * borrowed).cast("long").alias("lower"), (F.col("given") + F.col("n") * borrowed).cast("long").alias("upper"), F.col("exact").cast("long").alias("exact"))


def compare(counted: DataFrame, target: int) -> DataFrame:
    """sign and by: -1, 0 or 1 for a counter below, at or above a target, and whether bounds were enough to tell."""
    far = (F.col("upper") < target) | (F.col("lower") > target)
    return counted.select(F.signum(F.col("exact") - F.lit(target)).cast("int").alias("sign"), F.when(far, "bounds").otherwise("exact").alias("by"))


def batch_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """size and n: how many batches (rows of equal keys) had so many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def log_rows(added: DataFrame, flushed: DataFrame, rows: int) -> DataFrame:
    """first, last and blocks of rows of a log's summary: blocks by the time they were added at, less those flushed; a row ends when it has `rows` blocks.

    added and flushed have (time, blocks); both are added up by time before anything is sorted, so one row a time is.
    """
    net = added.select("time", "blocks").unionByName(flushed.select("time", (-F.col("blocks")).alias("blocks"))).groupBy("time").agg(F.sum("blocks").alias("blocks")).where("blocks > 0")
    running = net.selectExpr("time", "blocks", "sum(blocks) over (order by time) - blocks as before")
    return running.groupBy(F.floor(F.col("before") / rows).alias("row")).agg(F.min("time").alias("first"), F.max("time").alias("last"), F.sum("blocks").alias("blocks")).drop("row")


def unique_numbers(df: DataFrame, key: str, bits: int, seed: int = 0) -> DataFrame:
    """key and number: a number of so many bits for each distinct key, no two alike; of keys that draw the same one the least keeps it, the others draw again.

    ValueError if there are more than half as many keys as numbers.
    """
    keys = materialize(df.select(key).distinct(), "keys")
    if keys.count() > 1 << (bits - 1):
        raise ValueError("too many keys for so few bits")
    left, done, turn = keys, None, 0
    while True:
        drawn = left.select(key, F.pmod(F.xxhash64(key, F.lit(seed + turn)), F.lit(1 << bits)).alias("number"))
        if done is not None:
            drawn = drawn.join(done.select("number"), "number", "left_anti")
        new = drawn.groupBy("number").agg(F.min(key).alias(key)).select(key, "number")
        done = materialize(new if done is None else done.unionByName(new), "numbers")
        left = materialize(keys.join(done.select(key), key, "left_anti"), "left")
        if left.isEmpty():
            return done
        turn += 1
