"""Versions of a table: differences, changes since a birth mark, time travel, cancelled log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.functions.scalars import escape_path
from shalebed.operators.hierarchy import closure


def diff(old: DataFrame, new: DataFrame, key: str, generation: str, name: str, values: list[str]) -> DataFrame:
    """key, change and both names: + added, - removed, R renamed, M modified. Another generation is another object."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col(f"o.{key}") == F.col(f"n.{key}")) & (F.col(f"o.{generation}") == F.col(f"n.{generation}")), "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"o.{v}").eqNullSafe(F.col(f"n.{v}"))
    change = F.when(F.col(f"o.{key}").isNull(), "+").when(F.col(f"n.{key}").isNull(), "-").when(~F.col(f"o.{name}").eqNullSafe(F.col(f"n.{name}")), "R").when(~same, "M")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), change.alias("change"), F.col(f"o.{name}").alias("old_name"), F.col(f"n.{name}").alias("new_name")).where("change is not null")


def since(old: DataFrame, new: DataFrame, key: str, birth: str, mark: int) -> DataFrame:
    """What turns old into new: WRITE for rows born after mark, FREE for keys that are gone."""
    written = new.where(F.col(birth) > mark).select(key, F.lit("WRITE").alias("op"))
    freed = old.join(new, key, "left_anti").select(key, F.lit("FREE").alias("op"))
    return written.unionByName(freed)


def as_of(versions: DataFrame, at: int) -> DataFrame:
    """Rows alive at a mark: born by it and not yet dead."""
    return versions.where((F.col("birth") <= at) & (F.col("death").isNull() | (F.col("death") > at)))


def surviving(log: DataFrame, keys: list[str], allocated: str, freed: str) -> DataFrame:
    """Keys with more allocations than frees, and how many more."""
    return log.groupBy(*keys).agg((F.count_if(F.expr(allocated)) - F.count_if(F.expr(freed))).alias("left")).where("left > 0")


def latest(log: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """State after a log of upserts and removals (a null value): the entry of greatest seq decides."""
    return log.groupBy(*keys).agg(F.max_by(F.struct(value), seq).alias("v")).select(*keys, F.col(f"v.{value}").alias(value)).where(F.col(value).isNotNull())


def paths(objects: DataFrame) -> DataFrame:
    """object and path: names from the top down by slashes; objects has (object, parent, name), parent null at the top."""
    tree = objects.select(F.col("object").alias("id"), "parent")
    named = objects.select(F.col("object").alias("ancestor"), "name")
    steps = closure(tree).join(named, "ancestor").groupBy(F.col("id").alias("object")).agg(F.sort_array(F.collect_list(F.struct("distance", "name")), asc=False).alias("steps"))
    return steps.select("object", F.concat(F.lit("/"), F.array_join(F.transform("steps", lambda s: s["name"]), "/")).alias("path"))


#: Signs of types in a listing of changes.
SIGNS = {"block": "B", "character": "C", "directory": "/", "pipe": "|", "link": "@", "socket": "=", "file": "F"}


def change_line(mount: str = "", classify: bool = False, script: bool = False, times: bool = False, plain: bool = False) -> Column:
    """A change (change, type, old_name, new_name, links, seconds, nanoseconds) as text.

    The time of change first if asked for, the kind of change, the type's sign if asked for, the path, and for renamed
    ones both with an arrow (a tab in scripts). A change of the number of links follows in brackets. Bytes that are no
    visible ASCII are written in octal unless plain.
    """
    shown = lambda c: F.concat(F.lit(mount), F.col(c)) if plain else escape_path(F.concat(F.lit(mount), F.col(c)))
    sign = F.lit("?")
    for k, v in SIGNS.items():
        sign = F.when(F.col("type") == k, F.lit(v)).otherwise(sign)
    path = F.when(F.col("change") == "R", F.concat(shown("old_name"), F.lit("\t" if script else " -> "), shown("new_name"))).when(F.col("change") == "-", shown("old_name")).otherwise(shown("new_name"))
    links = F.when((F.col("change") == "M") & (F.col("links") != 0), F.concat(F.lit("\t("), F.when(F.col("links") > 0, "+").otherwise(""), F.col("links").cast("string"), F.lit(")"))).otherwise("")
    time = [F.concat(F.lpad(F.col("seconds").cast("string"), 10, " "), F.lit("."), F.lpad(F.col("nanoseconds").cast("string"), 9, "0"))] if times else []
    return F.concat(F.concat_ws("\t", *time, F.col("change"), *([sign] if classify else []), path), links)
