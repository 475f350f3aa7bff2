"""Counters and events in time order: rates, suppression, limits, averages, tiers, islands."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.operators.asof import asof


def deltas(df: DataFrame, keys: list[str], at: list[str], value: str, first: str = "zero") -> DataFrame:
    """df with delta: value less the one before it; the first is 0, or the value itself with first="value"."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*at))
    return df.withColumn("delta", F.coalesce(F.col(value) - before, F.col(value) if first == "value" else F.lit(0.0)))


def keep_last(df: DataFrame, keys: list[str], at: list[str], n: int) -> DataFrame:
    """The newest n rows of each key."""
    newest = W.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in at))
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def suppress_repeats(df: DataFrame, keys: list[str], at: list[str], seconds: str, expire: float) -> DataFrame:
    """Rows not seen within expire seconds before; every repeat, kept or not, starts the time again."""
    before = F.lag(seconds).over(W.partitionBy(*keys).orderBy(*at))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(seconds) - F.col("_before") > expire)).drop("_before")


def islands(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of consecutive numbers: keys, first, last and length."""
    line = W.partitionBy(*keys).orderBy(at)
    runs = df.select(*keys, at).distinct().withColumn("_run", F.col(at) - F.row_number().over(line))
    return runs.groupBy(*keys, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("length")).drop("_run")


def fold(df: DataFrame, keys: list[str], at: list[str], columns: list[str], start: Callable[[], Any], step: Callable[..., Any], result: str) -> DataFrame:
    """keys, at and `result` (name and type): an order-dependent fold of each key's rows, sorted by `at`.

    step(state, values of columns) gives the result of a row and may change the state that start() made for its key.
    Rows come sorted in batches and only the state is kept between them, so a key may have any number of rows.
    """
    names = [*dict.fromkeys([*keys, *at, *columns])]
    types = dict(df.dtypes)
    out, kind = result.split()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for t in batches:
            made = []
            for k, values in zip(zip(*(t[c] for c in keys)), zip(*(t[c] for c in columns))):
                if k != key:
                    key, state = k, start()
                made.append(step(state, *values))
            yield t[[*keys, *at]].assign(**{out: made})

    sorted_ = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *at)
    return sorted_.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in [*keys, *at]) + f", {out} {kind}")


def moving_average(df: DataFrame, keys: list[str], at: list[str], value: str, weight: int) -> DataFrame:
    """keys, at and ewma: the last average plus (value - average) / weight, cut to a whole number, never below 0."""

    def step(state: list[int], v: float) -> int:
        state[0] = max(0, state[0] + int((int(v) - state[0]) / max(weight, 1)))
        return state[0]

    return fold(df, keys, at, [value], lambda: [0], step, "ewma long")


def limit_rate(df: DataFrame, keys: list[str], at: list[str], seconds: str, interval: float, burst: int) -> DataFrame:
    """keys, at and passed: at most burst rows in an interval, which begins with the first row after the last one ended; that one always passes."""

    def step(state: list, s: float) -> bool:
        if state[0] is None or s - state[0] >= interval:
            state[:] = [s, 0]
        state[1] += 1
        return state[1] == 1 or state[1] <= burst

    return fold(df, keys, at, [seconds], lambda: [None, 0], step, "passed boolean")


#: The coarsest tier first, and how far a sample must be from its tier's last one.
TIERS = (("month", 30 * 86400), ("day", 86400), ("minute", 0))


def tiers(df: DataFrame, keys: list[str], seconds: str, mark: str, spans: tuple[tuple[str, int], ...] = TIERS, keep: int = 256) -> DataFrame:
    """keys, tier, seconds and mark: a sample goes to the coarsest tier whose last one is old enough, and each tier keeps its newest rows.

    Samples come in order of seconds and mark; one that is older than the last of a tier doesn't go there. Of equal
    times in a tier, a greater mark replaces the last one's and is added too; another is left out.
    """

    def step(state: dict[str, tuple], s: float, m: int) -> str | None:
        for name, span in spans:
            last = state.get(name)
            if last is None or s - last[0] >= span:
                if last is not None and last[0] == s and m <= last[1]:
                    return None
                state[name] = (s, m)
                return name
        return None

    placed = fold(df, keys, [seconds, mark], [seconds, mark], dict, step, "tier string").where("tier is not null")
    same = W.partitionBy(*keys, "tier", seconds).orderBy(mark)
    newest = W.partitionBy(*keys, "tier").orderBy(F.col(seconds).desc(), F.col("_own").desc())
    marked = placed.withColumn("_own", F.col(mark)).withColumn(mark, F.coalesce(F.lead("_own").over(same), "_own"))
    return marked.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).select(*keys, "tier", seconds, mark)


def closest(left: DataFrame, samples: DataFrame, keys: list[str], at: str, seconds: str, mark: str, how: str) -> DataFrame:
    """left with `mark` of the sample found in each tier by floor or ceiling, the closest of them by time; the coarser tier where two are as close.

    samples are what `tiers` returns. Null where no tier has one.
    """
    best = None
    for place, (tier, _) in enumerate(TIERS):
        found = asof(left, samples.where(F.col("tier") == tier).select(*keys, F.col(seconds).alias(at), mark), keys, at, mark, how)
        hit = F.when(F.col(f"at_{how}").isNotNull(), F.struct(F.abs(F.col(at) - F.col(f"at_{how}")).alias("d"), F.lit(place).alias("p"), F.col(f"value_{how}").alias("v")))
        one = found.select(F.struct(*left.columns).alias("_id"), hit.alias("_hit"))
        best = one if best is None else best.unionByName(one)
    return best.groupBy("_id").agg(F.min("_hit").alias("_hit")).select("_id.*", F.col("_hit.v").alias(mark))
