"""Whole pools: scans over several datasets, checkpoints, stream plans, verification, grants, computed properties, UDAFs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shalebed.operators.catalog import owner


def pool_scan(datasets: dict[str, DataFrame], since: int = 0) -> DataFrame:
    """Rows of all datasets born after a mark, with the dataset's name; columns that one lacks are null."""
    parts = (df.where(F.col("birth") > since).withColumn("dataset", F.lit(n)) for n, df in sorted(datasets.items()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def rewind(versions: DataFrame, at: int) -> DataFrame:
    """versions (birth, death) as they were at a checkpoint: what was born later is gone, what died later lives again."""
    return versions.where(F.col("birth") <= at).withColumn("death", F.when(F.col("death") <= at, F.col("death")))


def held_by_checkpoint(versions: DataFrame, at: int) -> DataFrame:
    """Rows that only a checkpoint keeps, which its discarding frees: alive at it and dead since."""
    return versions.where((F.col("birth") <= at) & (F.col("death") > at))


def send_plan(catalog: DataFrame, root: str, exclude: tuple[str, ...] = (), since: int | None = None) -> DataFrame:
    """dataset, previous and snapshot for each stream that sends root and all below it: every snapshot from the one before it.

    Datasets named in exclude are left out with all below them. With since, only snapshots made after that time; the
    first of them still starts from the one before.
    """
    name = owner("name")
    out = F.lit(False)
    for e in exclude:
        out = out | (name == e) | name.startswith(e + "/")
    snapshots = catalog.where((F.col("kind") == "snapshot") & ((name == root) | name.startswith(root + "/")) & ~out)
    line = W.partitionBy(name).orderBy("created", "name")
    steps = snapshots.select(name.alias("dataset"), F.lag("name").over(line).alias("previous"), F.col("name").alias("snapshot"), "created")
    return (steps if since is None else steps.where(F.col("created") > since)).drop("created")


def scrub(blocks: DataFrame, payload: str, digest: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks born from first to last whose content doesn't give the digest that is stored with them."""
    rows = blocks
    if first is not None:
        rows = rows.where(F.col("birth") >= first)
    if last is not None:
        rows = rows.where(F.col("birth") <= last)
    return rows.where(F.sha2(payload, 256) != F.col(digest))


def regrant(grants: DataFrame, changes: DataFrame) -> DataFrame:
    """grants (id, who, scope, perm) after changes (seq, id, who, scope, perm, op): the last of each decides, op set or unset; unset with a null perm takes all of (id, who, scope) that came before."""
    keys = ["id", "who", "scope"]
    rows = grants.select(*keys, "perm", F.lit(-1).cast("long").alias("seq"), F.lit("set").alias("op")).unionByName(changes.select(*keys, "perm", F.col("seq").cast("long").alias("seq"), "op"))
    last = rows.where("perm is not null").groupBy(*keys, "perm").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")).where("op = 'set'")
    cleared = rows.where("perm is null and op = 'unset'").groupBy(*keys).agg(F.max("seq").alias("_cleared"))
    return last.join(cleared, keys, "left").where("_cleared is null or seq > _cleared").select(*keys, "perm")


def computed(datasets: DataFrame, requests: DataFrame, snapshots: DataFrame, users: DataFrame) -> DataFrame:
    """requests (name, property) with value.

    datasets has (name, used, referenced, logical); `ratio` is 100 logical / used. `written@tag` is what was written
    since a snapshot (snapshots: name, tag, written), `userused@who` what one uses (users: name, who, used). Null for
    other properties and for what is not there.
    """
    part = F.col("property")
    prefix, rest = F.substring_index(part, "@", 1), F.when(part.contains("@"), F.substring_index(part, "@", -1))
    asked = requests.withColumn("_p", prefix).withColumn("_q", rest)
    ratio = F.when(F.col("used") > 0, F.floor(100 * F.col("logical") / F.col("used"))).otherwise(100)
    plain = {"used": F.col("used"), "referenced": F.col("referenced"), "ratio": ratio}
    each = (F.struct(F.lit(p).alias("_p"), F.lit(None).cast("string").alias("_q"), v.cast("long").alias("value")) for p, v in plain.items())
    flat = datasets.select("name", F.inline(F.array(*each)))
    flat = flat.unionByName(snapshots.select("name", F.lit("written").alias("_p"), F.col("tag").cast("string").alias("_q"), F.col("written").cast("long").alias("value")))
    flat = flat.unionByName(users.select("name", F.lit("userused").alias("_p"), F.col("who").cast("string").alias("_q"), F.col("used").cast("long").alias("value")))
    a, f = asked.alias("a"), flat.alias("f")
    return a.join(f, (F.col("a.name") == F.col("f.name")) & (F.col("a._p") == F.col("f._p")) & F.col("a._q").eqNullSafe(F.col("f._q")), "left").select("a.name", "a.property", "f.value")


def exists(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """names with exists."""
    return names.join(catalog.select("name").distinct().withColumn("exists", F.lit(True)), "name", "left").select("name", F.coalesce("exists", F.lit(False)).alias("exists"))


def log_records(events: DataFrame) -> DataFrame:
    """kind, records, bytes, first and last number of an intent log's records (seq, kind, payload), and of all (kind null)."""
    return events.rollup("kind").agg(F.count("*").alias("records"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def record_dump(records: DataFrame, most: int = 16) -> DataFrame:
    """seq and text: kind and place of each record, and its first bytes in hexadecimal and as visible ASCII."""
    head = F.substring(F.col("payload").cast("binary"), 1, most)
    shown = F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^ -~]", ".")
    place = F.format_string("%s object = %d offset = %d length = %d", F.col("type"), F.col("object"), F.col("offset"), F.coalesce(F.octet_length("payload"), F.lit(0)))
    data = F.concat(F.lit(" data = "), F.lower(F.hex(head)), F.lit(" |"), shown, F.lit("|"))
    return records.select("seq", F.concat(place, F.when(F.col("payload").isNotNull(), data).otherwise("")).alias("text"))


def geometric_mean(x: Column | str) -> Column:
    """A grouped aggregate in pandas, for what no built-in one does: the geometric mean of positive values."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> float:
        return float(np.exp(np.log(s[s > 0]).mean()))

    return run(x)
