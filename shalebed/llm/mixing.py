"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.llm.common import WORD, materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of a block at most, words of a shard at least, shards of a source at most, and times a document may be taken.
BLOCK, SHARD, SHARDS, MOST = 64, 1 << 17, 1 << 16, 3
#: Blocks that a table has at least, if it has as many words: small tables have smaller blocks, so small sources get their share.
BLOCKS = 1 << 20
#: Multipliers of the seeded order of blocks; primes above any number of blocks of a shard, so each gives a permutation.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _seeded(seed: str, *by: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))), 1, 15), 16, 10).cast("long")


def apportion(units: DataFrame, group: list[str], order: list[Column], weight: str, seats: str) -> DataFrame:
    """units with `quota`: seats (one number within each group) dealt to weights by the highest quotients w / (2k - 1).

    Nearly all seats follow from two divisors that give too few and too many; only quotients between them, about two for
    each unit, are ranked. Equal quotients go by `order`. Units of weight 0 get nothing.
    """
    w = W.partitionBy(*group)
    bounded = (
        units.withColumn("_t", F.sum(weight).over(w))
        .withColumn("_n", F.count(F.when(F.col(weight) > 0, 1)).over(w))
        .withColumn("_i", F.row_number().over(w.orderBy(*order)))
        .withColumn("_lo", F.when(F.col(weight) > 0, F.greatest(F.lit(0), F.floor(F.col(weight) * (F.col(seats) - F.col("_n") / 2) / F.col("_t") + 0.5))).otherwise(0).cast("long"))
        .withColumn("_hi", F.when(F.col(weight) > 0, F.greatest(F.col("_lo"), F.floor(F.col(weight) * (F.col(seats) + F.col("_n") / 2) / F.col("_t") + 0.5) + 1)).otherwise(0).cast("long"))
        .withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    )
    kept = [c for c in bounded.columns if c != "_hi"]
    each = bounded.withColumn("_k", F.explode(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo") + 1, F.col("_hi"))).otherwise(F.array(F.lit(None).cast("long")))))
    ranked = each.withColumn("_r", F.row_number().over(w.orderBy((F.col(weight) / (2 * F.col("_k") - 1)).desc_nulls_last(), "_i")))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_r") <= F.col("_left")), 1).otherwise(0))
    return ranked.groupBy(*kept).agg(won.alias("_won")).withColumn("quota", F.col("_lo") + F.col("_won")).select(*units.columns, "quota")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target: all words shared by weight, no source above `most` times its size."""
    every = W.partitionBy(F.lit(1))
    by_ratio = every.orderBy("ratio", "number")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    numbered = sources.withColumn("number", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("spot", F.row_number().over(by_ratio))
        .withColumn("first", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("spot", "level"))).over(every))
    )
    return level.select("source", "source_size", "number", "total", F.when(F.col("first").isNull() | (F.col("spot") < F.col("first.spot")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.level")).alias("target"))


def _taken(start: Column, size: Column, block: Column, blocks: Column, chosen: Column, seed: Column) -> Column:
    """Words of [start, start + size) in the chosen ones of a shard's blocks: those that a seeded permutation puts first.

    Block j covers words j * block to (j + 1) * block. Its place is (multiplier * j + shift) modulo the number of
    blocks; multiplier and shift follow from the seed, so the places are a permutation and no block needs a row.
    """
    multiplier = F.element_at(F.array(*map(F.lit, PRIMES)), (F.pmod(seed, F.lit(len(PRIMES))) + 1).cast("int")).cast("long")
    first, last = F.floor(start / block).cast("long"), F.floor((start + size - 1) / block).cast("long")
    place = lambda j: F.pmod(multiplier * j + F.shiftright(seed, 3), blocks)
    overlap = lambda j: F.least(start + size, (j + 1) * block) - F.greatest(start, j * block)
    some = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda n, j: n + F.when(place(j) < chosen, overlap(j)).otherwise(F.lit(0).cast("long")))
    return F.when((size > 0) & (chosen > 0), some).otherwise(F.lit(0).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", block: int = BLOCK, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    docs has doc_id, text and source; of other columns only those named in `carry` are read, and returned as they are.
    Returns one row for each of docs: doc_id, source, size (words of the text; 0 for a null text), source_size, target,
    taken. A null source is a source of its own, last in order.

    Documents are dealt by a seeded hash of doc_id to shards of their source and laid end to end in a seeded order;
    every `block` words are a block (fewer in tables of under BLOCKS blocks; a shard's last one may be short). Blocks go
    to sources and then to shards by highest quotients, an integer quota for each. A shard takes all its blocks as often
    as its quota holds them and then those that come first in a seeded permutation, so no document exceeds `most` times
    its size. Repeated rows count as rows; rows tied in the seeded order go by doc_id, size and a hash of the text, so
    equal texts alone change places. A table without words takes 0 of each; an empty table gives no rows. Reruns agree.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)]
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), *kept), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    every = W.partitionBy(F.lit(1))
    width = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.sum("source_size").over(every) / BLOCKS))).cast("long")
    shards = F.least(F.lit(SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD))).cast("long")
    with_seats = sources.withColumn("block", width).withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long")).withColumn("shards", shards).withColumn("one", F.lit(1))
    quotas = materialize(apportion(with_seats, ["one"], [F.col("number")], "target", "seats"), "quotas")
    # One row a source: broadcast only if Spark finds it small.
    q = quotas.select(F.col("source").alias("s"), "source_size", "target", "shards", "block", F.col("quota").alias("blocks"))
    dealt = sized.join(q, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", F.pmod(_seeded(seed, "doc_id"), F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("block").alias("block"))
    of_shard = apportion(shards, ["source"], [F.col("shard")], "shard_size", "blocks").withColumn("n", F.ceil(F.col("shard_size") / F.col("block")))
    whole = F.when(F.col("n") > 0, F.least(F.lit(most), F.floor(F.col("quota") / F.col("n")))).otherwise(0).cast("long")
    part = F.when(whole < most, F.col("quota") - whole * F.col("n")).otherwise(0).cast("long")
    words = materialize(of_shard.select(F.col("source").alias("s"), F.col("shard").alias("h"), "n", whole.alias("whole"), part.alias("part"), _seeded(seed + "-blocks", "source", "shard").alias("seed")), "shards")
    placed = dealt.join(words, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    line = W.partitionBy("source", "shard").orderBy(_seeded(seed + "-order", "doc_id"), "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    started = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0)))
    taken = F.col("whole") * F.col("size") + _taken(F.col("start"), F.col("size"), F.col("block"), F.col("n"), F.col("part"), F.col("seed"))
    return started.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)))
