"""Objects as rows of blocks (object, blkid, payload), allocation logs as packed words, and remapped ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.functions.scalars import bits
from shalebed.operators.intervals import containing


def read_range(blocks: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """object and payload: bytes offset to offset + length of every object that has a block there; only such blocks are read.

    Blocks hold `size` bytes; where one is missing or short, zeros keep the place of what follows.
    """
    first, last = offset // size, (offset + length - 1) // size
    met = blocks.where(F.col("blkid").between(first, last))
    start = F.greatest(F.lit(offset) - F.col("blkid") * size, F.lit(0)).cast("int")
    end = F.least(F.lit(offset + length) - F.col("blkid") * size, F.lit(size)).cast("int")
    cut = met.select("object", "blkid", F.rpad(F.hex(F.substring("payload", start + 1, end - start)), 2 * (end - start), "0").alias("h"))
    parts = cut.groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("blkid", "h"))).alias("m"))

    def part(i: Column) -> Column:
        bytes_ = F.least(F.lit(offset + length) - i * size, F.lit(size)) - F.greatest(F.lit(offset) - i * size, F.lit(0))
        return F.coalesce(F.col("m")[i], F.repeat(F.lit("00"), bytes_.cast("int")))

    every = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))
    return parts.select("object", F.unhex(F.concat_ws("", F.transform(every, part))).alias("payload"))


def next_object(objects: DataFrame, after: int, since: int, holes: bool = False) -> DataFrame:
    """The least object above `after` that is born after `since`; or, with holes, the first number that none has."""
    if not holes:
        return objects.where((F.col("object") > after) & (F.col("birth") > since)).agg(F.min("object").alias("object"))
    # A number is free if it follows one that is taken (or `after`) and is not taken itself.
    taken = objects.where(F.col("object") > after).select("object").distinct()
    candidates = taken.select((F.col("object") + 1).alias("object")).unionByName(objects.sparkSession.createDataFrame([(after + 1,)], "object long"))
    return candidates.join(taken, "object", "left_anti").agg(F.min("object").alias("object"))


def encode_segment(op: Column | str, start: Column | str, length: Column | str) -> Column:
    """One log word: 1 bit of kind (ALLOC 0, FREE 1) at 15, length - 1 in bits 0 to 14, start in bits 16 to 62. Fits lengths up to 32,768."""
    op, start, length = (F.col(x) if isinstance(x, str) else x for x in (op, start, length))
    return F.shiftleft(start.cast("long"), 16).bitwiseOR(F.shiftleft(F.when(op == "FREE", 1).otherwise(0).cast("long"), 15)).bitwiseOR((length - 1).cast("long"))


def decode_segment(word: Column | str) -> Column:
    """struct(op, start, length) of a log word; debug words, with the highest bit set, are null."""
    w = F.col(word) if isinstance(word, str) else word
    return F.when(w >= 0, F.struct(F.when(bits(w, 15, 1) == 1, "FREE").otherwise("ALLOC").alias("op"), bits(w, 16, 47).alias("start"), (bits(w, 0, 15) + 1).alias("length")))


def remap(ranges: DataFrame, mapping: DataFrame, width: int) -> DataFrame:
    """ranges (id, start, end) split over mapping (lo, hi, to) entries: id, start, end and the new place `to` of each piece.

    Entries are disjoint. Both are listed in the buckets of `width` that they meet; a piece is made in the bucket where
    it begins. What no entry covers is left out.
    """

    def listed(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.where(F.col(lo) < F.col(hi)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    both = listed(ranges, "start", "end").join(listed(mapping, "lo", "hi"), "_b").where("start < hi and lo < end")
    begin = F.greatest("start", "lo")
    return both.where(F.floor(begin / width) == F.col("_b")).select("id", begin.alias("start"), F.least("end", "hi").alias("end"), (F.col("to") + begin - F.col("lo")).alias("to"))


def damaged(errors: DataFrame, datasets: DataFrame) -> DataFrame:
    """errors (head, object, birth, death) with each dataset (name, head, created) that still refers to the block.

    A snapshot does if it was made at or after birth and before death; the head itself (created null) if the block is
    alive. Lives meet snapshots in buckets as wide as a life is long, so those of other times don't meet.
    """
    heads = errors.where("death is null").join(datasets.where("created is null"), "head").select("name", "object")
    end = datasets.agg(F.coalesce(F.max("created"), F.lit(0)).alias("_end"))
    lives = errors.join(F.broadcast(end)).select("head", "object", F.col("birth").alias("lo"), F.coalesce("death", F.greatest("_end", "birth") + 1).alias("hi"))
    made = containing(datasets.where("created is not null"), lives, ["head"], "created", "lo", "hi")
    return heads.unionByName(made.select("name", "object"))
