"""Logs over tables: base and delta, rings with a cursor, gathered requests, changes that descend a tree, damaged bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.operators import hierarchy
from shalebed.operators.ranking import numbered


def reload(base: DataFrame, log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """key, seq and value: the newest of base and log; a null value in the log removes the key."""
    both = base.select(key, seq, value).unionByName(log.select(key, seq, value))
    return both.groupBy(key).agg(F.max_by(F.struct(seq, value), seq).alias("r")).select(key, "r.*").where(F.col(value).isNotNull())


def flush(base: DataFrame, log: DataFrame, key: str, seq: str, value: str, through: int) -> tuple[DataFrame, DataFrame]:
    """The base with all log entries up to `through`, and the log that is left; reload of both is as before."""
    return reload(base, log.where(F.col(seq) <= through), key, seq, value), log.where(F.col(seq) > through)


def ring_next(events: DataFrame, eid: str, cursor: int, capacity: int, n: int) -> DataFrame:
    """The next n events after cursor of a ring that keeps the newest `capacity`, and how many after it were dropped.

    Event numbers have no holes, so the greatest one tells where the ring begins.
    """
    top = events.agg(F.coalesce(F.max(eid), F.lit(0)).alias("top")).first()["top"]
    begin = max(cursor + 1, top - capacity + 1)
    return events.where(F.col(eid) >= begin).orderBy(eid).limit(n).withColumn("dropped", F.lit(begin - cursor - 1).cast("long"))


def gather(requests: DataFrame, keys: list[str], gap: int, most: int) -> DataFrame:
    """keys, start, end and n: neighbours in order of start made one while the gap and the total stay within bounds.

    A gap above the bound always ends a request, so runs between such gaps are independent: each task folds a share of
    a key's runs.
    """
    line = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    runs = requests.select(*keys, "start", "end").withColumn("_new", (reach.isNull() | (F.col("start") > reach + gap)).cast("int")).withColumn("_share", F.floor(F.sum("_new").over(line) / 4096)).drop("_new")

    def fold(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["start", "end"])
        out: list[list[int]] = []
        for start, end in zip(t["start"].tolist(), t["end"].tolist()):
            if out and start - out[-1][1] <= gap and max(end, out[-1][1]) - out[-1][0] <= most:
                out[-1][1] = max(end, out[-1][1])
                out[-1][2] += 1
            else:
                out.append([start, end, 1])
        got = pd.DataFrame(out, columns=["start", "end", "n"])
        return got.assign(**{k: t[k].iloc[0] for k in keys})[[*keys, "start", "end", "n"]]

    types = dict(requests.dtypes)
    return runs.groupBy(*keys, "_share").applyInPandas(fold, ", ".join(f"{k} {types[k]}" for k in keys) + ", start long, end long, n long")


def elevator(requests: DataFrame, offset: str, last: int) -> DataFrame:
    """requests with place: those at or after the last offset first, then from the lowest on."""
    return numbered(requests, [(F.col(offset) < last).asc(), F.col(offset).asc()], "place")


def inherited_changes(tree: DataFrame, before: DataFrame, after: DataFrame, default: str) -> DataFrame:
    """id, old and new for every node whose value, set on it or inherited, is changed by other local values."""
    old = hierarchy.inherit(tree, before, default).select("id", F.col("value").alias("old"))
    new = hierarchy.inherit(tree, after, default).select("id", F.col("value").alias("new"))
    return old.join(new, "id").where("old <> new")


def bit_errors(df: DataFrame, good: str, bad: str) -> DataFrame:
    """bit, set and cleared: how often each of 64 bits was wrongly set or cleared; bits without errors are left out.

    Counted in one pass as 128 sums that executors combine, so rows are not multiplied.
    """
    wrong = df.select(F.col(bad).bitwiseAND(F.bitwise_not(F.col(good))).alias("s"), F.col(good).bitwiseAND(F.bitwise_not(F.col(bad))).alias("c"))
    sums = wrong.agg(*(F.coalesce(F.sum(F.getbit(x, F.lit(i))), F.lit(0)).cast("long").alias(f"{x}{i}") for i in range(64) for x in "sc"))
    rows = F.array(*(F.struct(F.lit(i).alias("bit"), F.col(f"s{i}").alias("set"), F.col(f"c{i}").alias("cleared")) for i in range(64)))
    return sums.select(F.inline(rows)).where("set > 0 or cleared > 0")


def best_name(names: DataFrame, keys: list[str], name: str, wanted: str, order: str) -> DataFrame:
    """The name of each key: the one that is wanted (a boolean), else the most frequent, else the earliest by order."""
    counts = names.groupBy(*keys, name).agg(F.max(wanted).alias("_w"), F.count("*").alias("_n"), F.min(order).alias("_o"))
    return counts.groupBy(*keys).agg(F.max_by(name, F.struct("_w", "_n", -F.col("_o"))).alias(name))
