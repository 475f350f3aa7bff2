"""Lists of dead blocks in buckets by birth, redaction lists, queues of trees, and error lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.operators.asof import asof
from shalebed.operators.hierarchy import closure
from shalebed.operators.intervals import at_least, coalesce


def bucketed(dead: DataFrame, marks: DataFrame) -> DataFrame:
    """dead (list, block, birth, size) with bucket: the last mark of its list below the birth, 0 if there is none."""
    asked = dead.withColumn("_t", F.col("birth") - 1)
    got = asof(asked, marks.select("list", F.col("mark").alias("_t"), F.col("mark").alias("_m")), ["list"], "_t", "_m", "floor")
    return got.select(*dead.columns, F.coalesce("value_floor", F.lit(0)).cast("long").alias("bucket"))


def space(lists: DataFrame, first: int, last: int) -> DataFrame:
    """list, blocks and bytes of blocks born after first and by last; buckets that lie outside whole are not read."""
    rows = lists.where((F.col("bucket") < last) & (F.col("birth") > first) & (F.col("birth") <= last))
    return rows.groupBy("list").agg(F.count("*").alias("blocks"), F.sum("size").alias("bytes"))


def merge(lists: DataFrame, source: int, target: int, marks: DataFrame) -> DataFrame:
    """All blocks of one list put into another's buckets; the source is empty then."""
    moved = lists.where(F.col("list") == source).drop("bucket").withColumn("list", F.lit(target).cast(lists.schema["list"].dataType))
    return lists.where(F.col("list") != source).unionByName(bucketed(moved, marks))


def drop_mark(lists: DataFrame, which: int, mark: int, marks: DataFrame) -> DataFrame:
    """lists without a mark of one list: the blocks of its bucket fall into the one before."""
    before = marks.where((F.col("list") == which) & (F.col("mark") < mark)).agg(F.coalesce(F.max("mark"), F.lit(0)).cast("long").alias("_before"))
    hit = (F.col("list") == which) & (F.col("bucket") == mark)
    return lists.join(F.broadcast(before)).withColumn("bucket", F.when(hit, F.col("_before")).otherwise(F.col("bucket"))).drop("_before")


def free(blocks: DataFrame, nested: DataFrame, root: int) -> DataFrame:
    """Blocks of a list and of all lists nested in it; blocks has (list, block), nested has (id, parent) of lists."""
    inside = closure(nested).where(F.col("ancestor") == root).select(F.col("id").alias("list"))
    return blocks.join(inside, "list", "left_semi")


def redaction(changed: DataFrame, keys: list[str], snapshots: int) -> DataFrame:
    """Ranges that every one of `snapshots` changed: changed has keys, snapshot, start and end."""
    whole = coalesce(changed, [*keys, "snapshot"])
    return at_least(whole, keys, snapshots)


def redacted_after(ranges: DataFrame, object_: int, at: int) -> DataFrame:
    """Ranges (object, start, end) from a resume point on, the one that holds it cut there."""
    left = ranges.where((F.col("object") > object_) | ((F.col("object") == object_) & (F.col("end") > at)))
    return left.withColumn("start", F.when((F.col("object") == object_) & (F.col("start") < at), F.lit(at).cast(ranges.schema["start"].dataType)).otherwise(F.col("start")))


def queue_page(tree: DataFrame, roots: DataFrame, after: tuple[int, str] | None, n: int) -> DataFrame:
    """The next n nodes (place, id, distance) of queued trees: queue order, then ids; resumed after the last pair seen.

    roots has (place, id): the trees in the order in which they were queued.
    """
    nodes = closure(tree).join(roots.select("place", F.col("id").alias("ancestor")), "ancestor").select("place", "id", "distance")
    if after is not None:
        nodes = nodes.where((F.col("place") > after[0]) | ((F.col("place") == after[0]) & (F.col("id") > after[1])))
    return nodes.orderBy("place", "id").limit(n)


def healed(errors: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """Errors without those that are healed."""
    return errors.join(good.select(*keys).distinct(), keys, "left_anti")
