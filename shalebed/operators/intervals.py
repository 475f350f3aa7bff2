"""Algebra of half-open integer intervals [start, end), kept as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def endpoints(df: DataFrame, keys: list[str], **counters: str) -> DataFrame:
    """One row for each position at which a counter changes; counters are SQL conditions on df. Empty intervals vanish."""
    ends = df.where("start < end").select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))).alias("e"), *(F.expr(c).cast("int").alias(n) for n, c in counters.items()))
    return ends.groupBy(*keys, F.col("e.pos").alias("pos")).agg(*(F.sum(F.col("e.d") * F.col(n)).cast("long").alias(n) for n in counters))


def segments(points: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Elementary segments [pos, next) with the counters' running totals."""
    line = W.partitionBy(*keys).orderBy("pos")
    return points.select(*keys, F.col("pos").alias("start"), F.lead("pos").over(line).alias("end"), *(F.sum(c).over(line).alias(c) for c in counters))


def coalesce(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Intervals merged where they overlap, touch, or lie no more than gap apart."""
    line = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    islands = df.where("start < end").withColumn("new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int")).withColumn("island", F.sum("new").over(line))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def at_least(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Maximal ranges that at least k intervals of a key cover: 1 is the union, the number of sets their intersection."""
    return coalesce(segments(endpoints(df, keys, n="true"), keys, ["n"]).where(F.col("n") >= k), keys)


def at_least_bucketed(df: DataFrame, k: int, width: int) -> DataFrame:
    """at_least over all rows as one set. Sums within buckets of positions, then over buckets, then inside each: no task sees all endpoints."""
    points = endpoints(df, [], n="true").withColumn("bucket", F.floor(F.col("pos") / width))
    sums = points.groupBy("bucket").agg(F.sum("n").alias("s"), F.min("pos").alias("first"))
    order = W.orderBy("bucket")
    carried = sums.select("bucket", (F.sum("s").over(order) - F.col("s")).alias("before"), F.lead("first").over(order).alias("next"))
    line = W.partitionBy("bucket").orderBy("pos")
    parts = points.join(carried, "bucket").select("bucket", F.col("pos").alias("start"), F.coalesce(F.lead("pos").over(line), "next").alias("end"), (F.sum("n").over(line) + F.col("before")).alias("n")).where(F.col("n") >= k)
    local = coalesce(parts, ["bucket"]).withColumn("i", F.row_number().over(W.partitionBy("bucket").orderBy("start"))).withColumn("n", F.count("*").over(W.partitionBy("bucket")))
    # Only the first and the last range of a bucket may go on in another.
    edge = (F.col("i") == 1) | (F.col("i") == F.col("n"))
    return local.where(~edge).select("start", "end").unionByName(coalesce(local.where(edge).select("start", "end"), []))


def difference(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Ranges covered where condition left holds and nowhere where right holds."""
    return coalesce(segments(endpoints(df, keys, a=left, b=right), keys, ["a", "b"]).where("a > 0 and b = 0"), keys)


def overlay(df: DataFrame, keys: list[str], priority: str, value: str) -> DataFrame:
    """Disjoint ranges, each with the value of the covering interval of least priority; equal neighbours are merged.

    Elementary cells meet intervals within buckets about as wide as the interval is long, so a key with many intervals is
    no product of them, nor is a long one among short ones.
    """
    held = df.where("start < end").select(*keys, "start", "end", priority, value)
    points = endpoints(df, keys, n="true").select(*keys, "pos")
    line = W.partitionBy(*keys).orderBy("pos")
    cells = points.select(*keys, F.col("pos").alias("s"), F.lead("pos").over(line).alias("e")).where("e is not null")
    hit = containing(cells, held, keys, "s", "start", "end").groupBy(*keys, F.col("s").alias("start"), F.col("e").alias("end")).agg(F.min_by(value, F.struct(priority, value)).alias(value))
    return coalesce(hit, [*keys, value])


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """What lies between the coalesced intervals of a key."""
    line = W.partitionBy(*keys).orderBy("start")
    return coalesce(df, keys).select(*keys, F.col("end").alias("start"), F.lead("start").over(line).alias("end")).where("end is not null")


def replay(log: DataFrame, keys: list[str], seq: str, op: str) -> DataFrame:
    """Free ranges after a log of ALLOC and FREE ranges, however they overlap: at each place the last entry decides."""
    last = log.withColumn("_p", -F.col(seq))
    return overlay(last, keys, "_p", op).where(F.col(op) == "FREE").drop(op)


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Each point with every range [lo, hi) of its keys that holds it, all columns of both.

    A range is listed in the two buckets at most that it meets of the power of two next above its length; a point is
    asked for once for each length class that there is (64 at most), so rows grow with the input, however lengths differ.
    """
    class_ = F.ceil(F.log2(F.greatest(F.col(hi) - F.col(lo), F.lit(1)).cast("double"))).cast("int")
    width = F.pow(F.lit(2.0), F.col("_class"))
    listed = ranges.where(F.col(lo) < F.col(hi)).withColumn("_class", class_).withColumn("_bucket", F.explode(F.array_distinct(F.array(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))))
    classes = sorted(r["_class"] for r in listed.select("_class").distinct().collect())
    asked = points.withColumn("_class", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("_bucket", F.floor(F.col(at) / width))
    return asked.join(listed, [*keys, "_class", "_bucket"]).where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_class", "_bucket")


def lookup(points: DataFrame, bands: DataFrame, at: str) -> DataFrame:
    """Each point with the band [lo, hi) that holds it; bands of any lengths."""
    return containing(points, bands, [], at, "lo", "hi")


def members(points: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points inside some range of their key, by one sweep: ranges are coalesced, and the last one that began before decides."""
    whole = coalesce(ranges, keys)
    marks = whole.select(*keys, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_end"))
    asked = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct(*points.columns).alias("_row"))
    line = W.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    swept = marks.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)).unionByName(asked).withColumn("_until", F.last("_end", ignorenulls=True).over(line))
    return swept.where("_kind = 1 and _at < _until").select("_row.*")
