"""Streams made from two versions of a table of blocks: records in order, sizes, resuming, scans with progress, condensing.

Blocks are rows (object, blkid, birth, size); offsets are blkid times the block size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.operators.intervals import coalesce

#: Bytes of a record's header and of a pointer to a block, and objects that one block of objects holds.
HEADER_BYTES, POINTER_BYTES, OBJECTS_A_BLOCK = 312, 128, 32
#: Kinds of records in the order in which an object's come.
KINDS = ("FREEOBJECTS", "OBJECT", "FREE", "WRITE")


def records(old: DataFrame, new: DataFrame, mark: int, block: int) -> DataFrame:
    """object, kind, offset and length of what turns old into new: objects that came or changed, runs of objects that went, freed ranges, and blocks born after mark.

    Runs of neighbours are one record for what is freed. Sorted by `order()` they make a stream.
    """
    written = new.where(F.col("birth") > mark)
    touched = written.select("object").distinct()
    gone = old.select("object").distinct().join(new.select("object").distinct(), "object", "left_anti")
    runs = coalesce(gone.select(F.lit(0).alias("_k"), F.col("object").alias("start"), (F.col("object") + 1).alias("end")), ["_k"])
    freed = old.join(new, ["object", "blkid"], "left_anti").join(gone, "object", "left_anti")
    holes = coalesce(freed.select("object", F.col("blkid").alias("start"), (F.col("blkid") + 1).alias("end")), ["object"])
    changed = touched.unionByName(holes.select("object")).distinct()
    none = F.lit(0).cast("long")
    return (
        runs.select(F.col("start").cast("long").alias("object"), F.lit("FREEOBJECTS").alias("kind"), none.alias("offset"), (F.col("end") - F.col("start")).cast("long").alias("length"))
        .unionByName(changed.select(F.col("object").cast("long").alias("object"), F.lit("OBJECT").alias("kind"), none.alias("offset"), none.alias("length")))
        .unionByName(holes.select(F.col("object").cast("long").alias("object"), F.lit("FREE").alias("kind"), (F.col("start") * block).cast("long").alias("offset"), ((F.col("end") - F.col("start")) * block).cast("long").alias("length")))
        .unionByName(written.select(F.col("object").cast("long").alias("object"), F.lit("WRITE").alias("kind"), (F.col("blkid") * block).cast("long").alias("offset"), F.col("size").cast("long").alias("length")))
    )


def order() -> list[Column]:
    """Stream order: by object; within one by kind, then by offset."""
    return [F.col("object"), F.when(F.col("kind").isin("FREEOBJECTS"), 0).when(F.col("kind") == "OBJECT", 1).otherwise(2), F.col("offset"), F.col("kind")]


def resumed(stream: DataFrame, object_: int, offset: int) -> DataFrame:
    """Records from a resume point on: later objects, and of its own object the record itself again and what follows the offset."""
    same = (F.col("object") == object_) & ((F.col("kind") == "OBJECT") | (F.col("offset") >= offset))
    return stream.where((F.col("object") > object_) | same)


def estimate(blocks: DataFrame, keys: list[str], record: int, compressed: bool) -> DataFrame:
    """keys and bytes of a stream: sums of size (or of psize) less a pointer and plus a header for each record's worth of uncompressed bytes."""
    sums = blocks.groupBy(*keys).agg(F.sum("size").alias("_u"), F.sum("psize").alias("_c"))
    n = F.floor(F.col("_u") / record)
    return sums.select(*keys, (F.col("_c" if compressed else "_u") + n * (HEADER_BYTES - POINTER_BYTES)).cast("long").alias("bytes"))


def mark_order(rows: DataFrame) -> list[Column]:
    """Order of bookmarks (object, level, blkid): what a walk from the top meets first; blocks of objects stand where their first object does."""
    first = F.when(F.col("object") == 0, F.col("blkid") * OBJECTS_A_BLOCK).otherwise(F.col("object"))
    leaf = F.when(F.col("object") == 0, 0).otherwise(F.col("blkid") * F.pow(F.lit(1024.0), F.col("level")).cast("long"))
    return [first, leaf, F.col("level").desc(), F.col("object"), F.col("blkid")]


def scan_step(todo: DataFrame, done: int | None, key: str, size: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """The next rows after `done` by key that fit in a budget of bytes, and progress: last, scanned, left and percent.

    The place to stop is found from sums over blocks of keys, so a step neither sorts nor moves the rows.
    """
    rest = todo if done is None else todo.where(F.col(key) > done)
    width = 4096
    sums = sorted((r["b"], r["s"]) for r in rest.groupBy(F.floor(F.col(key) / width).alias("b")).agg(F.sum(size).alias("s")).collect())
    total, stop = 0, None
    for b, s in sums:
        if total + s > budget and total:
            break
        total, stop = total + s, (b + 1) * width - 1
    step = rest.where(F.col(key) <= F.lit(stop if stop is not None else -1))
    every = sum(s for _, s in sums)
    last = step.agg(F.max(key).alias("last"))
    return step, last.select("last", F.lit(total).cast("long").alias("scanned"), F.lit(every - total).cast("long").alias("left"), F.lit(100.0 * total / every if every else 100.0).alias("percent"))


def condense(log: DataFrame, replayed: DataFrame, worth: float) -> tuple[DataFrame, bool]:
    """The replayed ranges instead of the log if that has at most `worth` times as many rows, and whether it does."""
    had, has = log.count(), replayed.count()
    return (replayed, True) if has <= worth * had else (log, False)
