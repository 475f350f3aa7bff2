"""Tables of datasets: (name, kind, created, origin), kind filesystem, snapshot or bookmark; origin is a snapshot's name.

Names are paths; fs@tag is a snapshot, fs#tag a bookmark. Each procedure takes a catalog and returns the changed one.
What it would refuse is found by `refusals` without changing anything, which is the dry run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.storage import materialize

COLUMNS = ("name", "kind", "created", "origin")


def owner(name: Column | str) -> Column:
    """The file system of a snapshot or bookmark; of a file system itself."""
    return F.substring_index(F.substring_index(name, "@", 1), "#", 1)


def _below(name: Column, root: str) -> Column:
    """The dataset root itself, what is below it, its snapshots and its bookmarks."""
    return (name == root) | name.startswith(root + "/") | name.startswith(root + "@") | name.startswith(root + "#")


def children(catalog: DataFrame, root: str, depth: int | None = None, kinds: tuple[str, ...] = ("filesystem", "snapshot", "bookmark")) -> DataFrame:
    """Rows below a dataset, itself included, of some kinds and to a depth; snapshots are as deep as their file system."""
    levels = F.size(F.split(owner("name"), "/")) - len(root.split("/"))
    found = catalog.where(_below(F.col("name"), root) & F.col("kind").isin(*kinds))
    return found if depth is None else found.where(levels <= depth)


def visible(catalog: DataFrame) -> DataFrame:
    """Rows whose names are neither internal ($) nor temporary (%)."""
    return catalog.where(~F.col("name").rlike("[$%]"))


def snapshot_span(catalog: DataFrame, spec: str) -> DataFrame:
    """Snapshots of fs@a%b (both ends), fs@a%, fs@%b, fs@a, or a list of these tags after the @, by created."""
    fs, _, tags = spec.partition("@")
    mine = catalog.where((F.col("kind") == "snapshot") & (owner("name") == fs))
    tag = F.substring_index("name", "@", -1)
    out = None
    for part in tags.split(","):
        low, span, high = part.partition("%")
        ends = mine.agg(F.max(F.when(tag == low, F.col("created"))).alias("_lo"), F.max(F.when(tag == (high if span else low), F.col("created"))).alias("_hi"))
        keep = F.lit(True)
        if low or not span:
            keep = keep & (F.col("created") >= F.col("_lo"))
        if high or not span:
            keep = keep & (F.col("created") <= F.col("_hi"))
        # One row of ends meets the snapshots.
        got = mine.join(F.broadcast(ends), on=F.lit(True)).where(keep).select(*COLUMNS)
        out = got if out is None else out.unionByName(got)
    return out.dropDuplicates(["name"])


def dependents(catalog: DataFrame, root: str) -> DataFrame:
    """Names below root and all clones made from them, with what is below those, and so on at any depth.

    Breadth first: each step keeps only names not met before, so every name is met once and loops end.
    """
    links = catalog.select(F.col("name").alias("child"), F.explode(F.array("origin", owner("name"), F.when((F.col("kind") == "filesystem") & F.col("name").contains("/"), F.regexp_replace("name", "/[^/]*$", "")))).alias("parent")).where("parent is not null and parent <> child")
    links = materialize(links.select("parent", "child").distinct(), "links")
    met = materialize(catalog.where(F.col("name") == root).select("name").distinct(), "met")
    step = met
    while True:
        new = step.join(links, step["name"] == links["parent"]).select(F.col("child").alias("name")).distinct().join(met, "name", "left_anti")
        step = materialize(new, "step")
        if step.isEmpty():
            return met.where(F.col("name") != root)
        met = materialize(met.unionByName(step), "met")


def snapshot(catalog: DataFrame, tag: str, at: int, root: str) -> DataFrame:
    """One new snapshot of every file system below root, all at one time."""
    new = children(catalog, root, kinds=("filesystem",)).select(F.concat("name", F.lit("@" + tag)).alias("name"), F.lit("snapshot").alias("kind"), F.lit(at).cast("long").alias("created"), F.lit(None).cast("string").alias("origin"))
    return catalog.select(*COLUMNS).unionByName(new)


def bookmark(catalog: DataFrame, source: str, tag: str) -> DataFrame:
    """A bookmark of a snapshot keeps its time after it is destroyed."""
    new = catalog.where(F.col("name") == source).select(F.concat(owner("name"), F.lit("#" + tag)).alias("name"), F.lit("bookmark").alias("kind"), "created", F.lit(None).cast("string").alias("origin"))
    return catalog.select(*COLUMNS).unionByName(new)


def clone(catalog: DataFrame, source: str, name: str, at: int) -> DataFrame:
    """A file system that starts from a snapshot."""
    new = catalog.where((F.col("name") == source) & (F.col("kind") == "snapshot")).select(F.lit(name).alias("name"), F.lit("filesystem").alias("kind"), F.lit(at).cast("long").alias("created"), F.col("name").alias("origin"))
    return catalog.select(*COLUMNS).unionByName(new)


def rename(catalog: DataFrame, old: str, new: str) -> DataFrame:
    """A dataset and all below it under another name; origins follow."""

    def moved(c: str) -> Column:
        return F.when(_below(F.col(c), old), F.concat(F.lit(new), F.substring(F.col(c), len(old) + 1, 1 << 20))).otherwise(F.col(c))

    return catalog.select(moved("name").alias("name"), "kind", "created", moved("origin").alias("origin"))


def promote(catalog: DataFrame, name: str) -> DataFrame:
    """A clone and its source change places: snapshots up to the origin move to the clone, and origins follow."""
    origin = catalog.where(F.col("name") == name).select(F.col("origin").alias("_from"))
    point = origin.join(catalog.select(F.col("name").alias("_from"), F.col("created").alias("_at")), "_from").select(owner("_from").alias("_fs"), "_from", "_at")
    up = point.join(catalog.select(F.col("name").alias("_fs"), F.col("origin").alias("_up")), "_fs")
    moving = catalog.where("kind = 'snapshot'").join(F.broadcast(up), (owner("name") == F.col("_fs")) & (F.col("created") <= F.col("_at"))).select(F.col("name").alias("_old"), F.concat(F.lit(name), F.substring("name", F.length("_fs") + 1, F.lit(1 << 20))).alias("_new"))
    # `up` is one row: it tells every row which two file systems change places.
    rows = catalog.join(F.broadcast(up), on=F.lit(True), how="left").join(moving, F.col("name") == F.col("_old"), "left").withColumn("name", F.coalesce("_new", "name")).drop("_old", "_new")
    to = F.concat(F.lit(name), F.substring("_from", F.length("_fs") + 1, F.lit(1 << 20)))
    changed = F.when(F.col("name") == name, F.col("_up")).when(F.col("name") == F.col("_fs"), to).otherwise(F.col("origin"))
    rows = rows.withColumn("origin", F.when(F.col("_fs").isNull(), F.col("origin")).otherwise(changed))
    return rows.join(moving, F.col("origin") == F.col("_old"), "left").select("name", "kind", "created", F.coalesce("_new", "origin").alias("origin"))


def rollback(catalog: DataFrame, to: str) -> DataFrame:
    """A file system as at a snapshot: its later snapshots and bookmarks go."""
    at = catalog.where(F.col("name") == to).agg(F.max("created").alias("_at"))
    later = (owner("name") == to.split("@")[0]) & F.col("kind").isin("snapshot", "bookmark") & (F.col("created") > F.col("_at"))
    return catalog.join(F.broadcast(at), on=F.lit(True)).where(~F.coalesce(later, F.lit(False))).select(*COLUMNS)


def refusals(catalog: DataFrame, holds: DataFrame, names: DataFrame) -> DataFrame:
    """name and reason for each of names (name) that may not be destroyed: missing, held, cloned or has children.

    holds has (name, tag). A snapshot whose clones are all in names too is not refused for them.
    """
    facts = _facts(catalog, holds, names).where("asked")
    reasons = F.array(F.when(~F.col("present"), "missing"), F.when(F.col("held"), "held"), F.when(F.col("cloned"), "cloned"), F.when(F.col("full"), "has children"))
    return facts.select("name", F.explode(F.array_compact(reasons)).alias("reason"))


def _facts(catalog: DataFrame, holds: DataFrame, names: DataFrame) -> DataFrame:
    """For each name: asked, present, held, cloned and full (has children), the last two by rows that are not asked for.

    The catalog meets the names once; then all facts are one aggregation by name.
    """
    asked = names.select("name").distinct()
    rows = catalog.select("name", "kind", "origin").join(asked.withColumn("_asked", F.lit(True)), "name", "left")
    stays = F.col("_asked").isNull()
    parent = F.when(F.col("kind") == "filesystem", F.when(F.col("name").contains("/"), F.regexp_replace("name", "/[^/]*$", ""))).when(F.col("kind") == "snapshot", owner("name"))

    def fact(name: Column | str, what: str) -> Column:
        return F.struct((F.col(name) if isinstance(name, str) else name).alias("name"), F.lit(what).alias("what"))

    own = rows.select(F.inline(F.array(fact("name", "present"), fact(F.when(stays, F.col("origin")), "cloned"), fact(F.when(stays, parent), "full"))))
    every = own.unionByName(asked.withColumn("what", F.lit("asked"))).unionByName(holds.select("name", F.lit("held").alias("what")))
    flags = [F.max(F.col("what") == w).alias(w) for w in ("asked", "present", "held", "cloned", "full")]
    return every.where("name is not null").groupBy("name").agg(*flags)


def destroy(catalog: DataFrame, holds: DataFrame, names: DataFrame) -> DataFrame:
    """The catalog without those of names that nothing refuses."""
    gone = _facts(catalog, holds, names).where("asked and present and not (held or cloned or full)").select("name")
    return catalog.join(gone, "name", "left_anti").select(*COLUMNS)


def reclaimable(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks and bytes that destroying all snapshots from time first to last would free.

    blocks has birth, death (null while alive), size and `before`: the time of the last snapshot older than first or
    null. A block is free if it was born after that snapshot and died by `last`, but not before first.
    """
    gone = blocks.where((F.col("death") > first) & (F.col("death") <= last) & (F.col("before").isNull() | (F.col("birth") > F.col("before"))))
    return gone.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
