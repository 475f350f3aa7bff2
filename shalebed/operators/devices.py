"""Trees of devices: walks, health, summaries, sampled counters, labels, names and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.operators.hierarchy import closure

#: States from the worst to the best.
WORST = ("FAULTED", "UNAVAIL", "REMOVED", "OFFLINE", "DEGRADED", "ONLINE")
#: Folders in which a device may stand under its short name.
FOLDERS = ("/dev/disk/by-vdev", "/dev/mapper", "/dev/disk/by-partlabel", "/dev/disk/by-label", "/dev/disk/by-uuid", "/dev/disk/by-id", "/dev/disk/by-path", "/dev")


def walk(tree: DataFrame) -> DataFrame:
    """id, depth and path (ids from the root) of every device; ordered by path, parents come before children."""
    up = closure(tree)
    return up.groupBy("id").agg(F.max("distance").alias("depth"), F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda s: s["ancestor"]).alias("path"))


def rank(state: Column | str) -> Column:
    """How bad a state is, 0 the worst."""
    s = F.col(state) if isinstance(state, str) else state
    return F.array_position(F.array(*map(F.lit, WORST)), s) - 1


def health(tree: DataFrame, states: DataFrame) -> DataFrame:
    """id and state: the worst state of a device and of all below it; states has (id, state)."""
    worst = closure(tree).join(states.select("id", rank("state").alias("_r")), "id").groupBy(F.col("ancestor").alias("id")).agg(F.min("_r").alias("_r"))
    return worst.select("id", F.get(F.array(*map(F.lit, WORST)), F.col("_r").cast("int")).alias("state"))


def summary(tree: DataFrame, leaves: DataFrame, level: int) -> DataFrame:
    """id, alloc, free, ops, bytes and errors of the devices of a level (0 the root): sums of leaves (id, alloc, space, ops, bytes, errors) below."""
    own = leaves.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("alloc", "space", "ops", "bytes", "errors")))
    up = closure(tree)
    tops = up.groupBy("id").agg(F.max("distance").alias("_d")).where(F.col("_d") == level).select(F.col("id").alias("ancestor"))
    sums = up.join(tops, "ancestor").join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(*(F.sum(c).alias(c) for c in ("alloc", "space", "ops", "bytes", "errors")))
    return sums.select("id", "alloc", (F.col("space") - F.col("alloc")).alias("free"), "ops", "bytes", "errors")


def sampled(counters: DataFrame, keys: list[str], at: str, values: list[str], skip_first: bool = False) -> DataFrame:
    """keys, at, and for each value what a second brought since the sample before; the first sample counts from 0 over its own time, or is left out."""
    line = W.partitionBy(*keys).orderBy(at)
    before = F.lag(at).over(line)
    seconds = F.col(at) - F.coalesce(before, F.lit(0))
    rates = [((F.col(v) - F.coalesce(F.lag(v).over(line), F.lit(0))) / seconds).alias(v) for v in values]
    out = counters.select(*keys, at, *rates, before.isNull().alias("_first"))
    return (out.where("not _first") if skip_first else out).drop("_first")


def latency(rows: DataFrame, keys: list[str], total: str, count: str) -> DataFrame:
    """keys and average: total time by count of requests, 0 for none."""
    return rows.groupBy(*keys).agg(F.sum(total).alias("_t"), F.sum(count).alias("_n")).select(*keys, F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(F.lit(0.0)).alias("average"))


def newest_labels(labels: DataFrame, group: str, device: str) -> DataFrame:
    """The best configuration of each group, that of its newest label (txg, then time), and the devices that were found with it or an older one."""
    best = labels.groupBy(group).agg(F.max_by("config", F.struct("txg", "time")).alias("config"), F.max("txg").alias("txg"))
    devices = labels.groupBy(group, device).agg(F.max("txg").alias("_txg")).groupBy(group).agg(F.count("*").alias("devices"))
    return best.join(devices, group)


def match_paths(short: DataFrame, paths: DataFrame) -> DataFrame:
    """name and path: full paths that a short name stands for, under one of FOLDERS or as it is, with a partition's number or without."""
    n = F.col("name")
    candidates = F.when(n.startswith("/"), F.array(n)).otherwise(F.transform(F.array(*map(F.lit, FOLDERS)), lambda f: F.concat(f, F.lit("/"), n)))
    wanted = short.select("name", F.explode(candidates).alias("_p"))
    plain = F.regexp_replace("path", r"(-part1|p1|(?<=[a-z])1)$", "")
    held = paths.select("path", F.explode(F.array_distinct(F.array("path", plain))).alias("_p"))
    return wanted.join(held, "_p").select("name", "path").distinct()


def missing_features(pools: DataFrame, known: list[str]) -> DataFrame:
    """pool and missing: features that a pool has in use and this library doesn't know; pools has (pool, feature, refs)."""
    return pools.where((F.col("refs") > 0) & ~F.col("feature").isin(*known)).groupBy("pool").agg(F.sort_array(F.collect_set("feature")).alias("missing"))


def other_projects(tree: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Files below root whose project differs from root's, or that don't hand it on; files has (id, project, inherit, directory)."""
    below = closure(tree).where(F.col("ancestor") == root).select("id")
    wanted = files.where(F.col("id") == root).select(F.col("project").alias("_p"))
    wrong = (F.col("project") != F.col("_p")) | (F.col("directory") & ~F.col("inherit"))
    return files.join(below, "id", "left_semi").join(F.broadcast(wanted)).where(wrong).select("id", "project", "inherit")


def enriched(rows: DataFrame, key: str, output: str, names: list[str]) -> DataFrame:
    """key and one column for each name: values of name=value words in a script's first line."""
    first = F.split(F.get(F.split(output, "\n"), 0), r"\s+")
    found = F.map_from_entries(F.array_distinct(F.transform(F.filter(first, lambda w: w.contains("=")), lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.regexp_replace(w, "^[^=]*=", "").alias("v")))))
    return rows.select(key, found.alias("_m")).select(key, *(F.col("_m")[n].alias(n) for n in names))
