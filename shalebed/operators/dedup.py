"""Tables of blocks by content: entries (checksum, size, refs), their classes, logs, clones and policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIQUE, DUPLICATE = "unique", "duplicate"


def class_of(refs: Column | str = "refs") -> Column:
    refs = F.col(refs) if isinstance(refs, str) else refs
    return F.when(refs > 1, DUPLICATE).otherwise(UNIQUE)


def entries(blocks: DataFrame, checksum: str, size: str) -> DataFrame:
    """class, checksum, size and refs of blocks by content."""
    return blocks.groupBy(F.col(checksum).alias("checksum"), F.col(size).alias("size")).agg(F.count("*").alias("refs")).select(class_of().alias("class"), "checksum", "size", "refs")


def page(table: DataFrame, cursor: tuple[str, str, int] | None, n: int) -> DataFrame:
    """The next n entries after a cursor in the order of class, checksum and size; the last one is the next cursor."""
    order = ("class", "checksum", "size")
    rows = table if cursor is None else table.where(F.struct(*order) > F.struct(*(F.lit(c).cast(table.schema[o].dataType).alias(o) for c, o in zip(cursor, order))))
    return rows.orderBy(*order).limit(n)


def write(table: DataFrame, blocks: DataFrame, checksum: str, size: str) -> DataFrame:
    """blocks with found: whether the table, or an earlier block by seq, has the content, so a reference is added and nothing written."""
    known = table.select(F.col("checksum").alias(checksum), F.col("size").alias(size), F.lit(True).alias("_known"))
    first = blocks.groupBy(checksum, size).agg(F.min("seq").alias("_first"))
    joined = blocks.join(first, [checksum, size]).join(known, [checksum, size], "left")
    return joined.select(*blocks.columns, (F.col("_known").isNotNull() | (F.col("seq") > F.col("_first"))).alias("found"))


def flush(table: DataFrame, log: DataFrame) -> DataFrame:
    """The table after a log of (checksum, size, delta): references added up, classes anew, entries without references gone; with `was`, the class before (null for new ones)."""
    deltas = log.groupBy("checksum", "size").agg(F.sum("delta").alias("_d"))
    both = table.select("checksum", "size", F.col("class").alias("was"), "refs").join(deltas, ["checksum", "size"], "full_outer")
    refs = F.coalesce("refs", F.lit(0)) + F.coalesce("_d", F.lit(0))
    return both.select("checksum", "size", "was", refs.cast("long").alias("refs")).where("refs > 0").select(class_of().alias("class"), "checksum", "size", "refs", "was")


def totals(table: DataFrame) -> DataFrame:
    """class, entries and refs, and of all classes (class null)."""
    return table.rollup("class").agg(F.count("*").alias("entries"), F.sum("refs").alias("refs"))


def take_first(table: DataFrame, order: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The n least entries, taken off, and the rest."""
    first = table.orderBy(*order).limit(n)
    return first, table.join(first.select(*order), order, "left_anti")


def pending(table: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """block and refs after pending references are reconciled: an add and a remove of one block cancel before the table is touched."""
    net = adds.select("block", F.lit(1).alias("d")).unionByName(removes.select("block", F.lit(-1).alias("d"))).groupBy("block").agg(F.sum("d").alias("refs")).where("refs <> 0")
    return table.select("block", "refs").unionByName(net).groupBy("block").agg(F.sum("refs").alias("refs")).where("refs > 0")


def clone_range(files: DataFrame, source: int, first: int, target: int, place: int, n: int) -> DataFrame:
    """files (file, blkid, block) with blocks first to first + n of one file shared at `place` of another; what stood there goes."""
    shared = files.where((F.col("file") == source) & F.col("blkid").between(first, first + n - 1)).select(F.lit(target).cast(files.schema["file"].dataType).alias("file"), (F.col("blkid") - first + place).cast(files.schema["blkid"].dataType).alias("blkid"), "block")
    return files.where(~((F.col("file") == target) & F.col("blkid").between(place, place + n - 1))).select("file", "blkid", "block").unionByName(shared)


def savings(blocks: DataFrame, block: str, size: str) -> DataFrame:
    """used, saved and ratio: bytes of blocks that references share, counted once, those that sharing saves, and 100 (used + saved) / used, 100 for none."""
    shared = blocks.groupBy(block).agg(F.max(size).alias("s"), F.count("*").alias("n")).where("n > 1")
    sums = shared.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("used"), F.coalesce(F.sum(F.col("s") * (F.col("n") - 1)), F.lit(0)).alias("saved"))
    return sums.select("used", "saved", F.when(F.col("used") == 0, 100).otherwise(F.floor((F.col("used") + F.col("saved")) * 100 / F.col("used"))).cast("long").alias("ratio"))


def referenced(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """blocks (device, offset) with refs: how many clones hold a block; 0 for one that no table row names."""
    return blocks.join(table.select("device", "offset", "refs"), ["device", "offset"], "left").withColumn("refs", F.coalesce("refs", F.lit(0)).cast("long"))


def same_content(left: str, right: str) -> Column:
    """Whether two structs of (checksum, size, strong) are provably equal (true), provably not (false) or must be compared (null)."""
    a, b = F.col(left), F.col(right)
    return F.when((a["size"] != b["size"]) | (a["checksum"] != b["checksum"]), F.lit(False)).when(a["strong"] & b["strong"], F.lit(True))


def needs_rewrite(block: str, policy: dict[str, object]) -> Column:
    """Whether a block (a struct of checksum kind, compression, copies, deduplicated) differs from a policy."""
    b = F.col(block)
    out = F.lit(False)
    for k, v in policy.items():
        out = out | ~b[k].eqNullSafe(F.lit(v))
    return out
