"""Listings: property lists, typed sorting, and lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.functions.nested import json_text
from shalebed.operators.ranking import numbered


def expand(spec: str, every: list[str], aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Columns of a comma list; `all` and aliases stand for several, each column is taken once. ValueError for others."""
    out: list[str] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        found = every if part == "all" else (aliases or {}).get(part, [part] if part in every else None)
        if found is None:
            raise ValueError(f"no property {part}")
        out += [c for c in found if c not in out]
    return out


def order(sort: list[tuple[str, bool]], valid: dict[str, Column] | None = None, name: str = "name") -> list[Column]:
    """Sort keys (column, ascending): rows for which a column is null or not valid come last either way; ties by name."""
    keys: list[Column] = []
    for column, ascending in sort:
        value = F.col(column) if column not in (valid or {}) else F.when(valid[column], F.col(column))
        keys.append(value.asc_nulls_last() if ascending else value.desc_nulls_last())
    return [*keys, F.col(name)]


def lines(df: DataFrame, columns: list[str], keys: list[Column], numeric: tuple[str, ...] = (), script: bool = False) -> DataFrame:
    """line and value: with script, tabs and no header; else a header (line 0) and columns as wide as their widest value.

    Nulls are shown as a dash.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns]
    rows = numbered(df, keys, "line").select(F.col("line").cast("int").alias("line"), *shown)
    if script:
        return rows.select("line", F.concat_ws("\t", *columns).alias("value"))
    widest = rows.agg(*(F.max(F.length(c)).alias(c) for c in columns)).first()
    head = df.sparkSession.createDataFrame([(0, *(c.upper() for c in columns))], ["line", *columns]).withColumn("line", F.col("line").cast("int"))
    cells = []
    for c in columns:
        width = max(len(c), widest[c] or 0)
        cells.append((F.lpad if c in numeric else F.rpad)(F.col(c), width, " "))
    return head.unionByName(rows).select("line", F.rtrim(F.concat_ws("  ", *cells)).alias("value"))


def object_ranges(spec: str, flags: dict[str, str]) -> Column:
    """A condition on `object` and `type` from `first:last:flags` parts, several by commas; an open end has no bound.

    Flags are letters of types; `A` stands for all, a minus before letters takes them away.
    """
    out = F.lit(False)
    for part in spec.split(","):
        first, _, rest = part.partition(":")
        last, _, letters = rest.partition(":")
        one = F.col("object") >= int(first or 0)
        if not rest and ":" not in part:
            one = F.col("object") == int(first)
        elif last:
            one = one & (F.col("object") <= int(last))
        plus, _, minus = letters.partition("-")
        if plus and plus != "A":
            one = one & F.col("type").isin(*(flags[x] for x in plus))
        if minus:
            one = one & ~F.col("type").isin(*(flags[x] for x in minus))
        out = out | one
    return out


def dataset_order(name: str = "name", created: str = "created") -> list[Column]:
    """Default order of datasets: by the name before @, a head before its snapshots, those by the time they were made (by name if that is 0)."""
    head = F.substring_index(name, "@", 1)
    return [head, F.when(F.col(name).contains("@"), 1).otherwise(0), F.when(F.col(name).contains("@"), F.col(created)), F.col(name)]


def mount_order(mountpoint: str = "mountpoint", name: str = "name", unmount: bool = False) -> list[Column]:
    """Mountpoints above before those below, rows without one last; for unmounting the other way round."""
    keys = [F.col(mountpoint), F.col(name)]
    return [k.desc_nulls_first() for k in keys] if unmount else [k.asc_nulls_last() for k in keys]


#: Where a value may come from.
SOURCES = ("local", "default", "inherited", "temporary", "received", "none")


def source_kind(id_: str = "id", source: str = "source", temporary: str | None = None, received: str | None = None) -> Column:
    """Where a value comes from: temporary or received flags first, then the node that set it, the default, or nothing (null)."""
    own = F.when(F.col(source).isNull(), "none").when(F.col(source) == "default", "default").when(F.col(source) == F.col(id_), "local").otherwise("inherited")
    if received:
        own = F.when(F.col(received) & (own == "local"), "received").otherwise(own)
    return F.when(F.col(temporary), "temporary").otherwise(own) if temporary else own


def cheap(columns: list[str], sort: list[str], fast: tuple[str, ...] = ("name", "created", "kind")) -> bool:
    """Whether a listing needs only columns that cost nothing to find."""
    return set(columns) | set(sort) <= set(fast)


def json_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text for each row, 7-bit ASCII, null members null."""
    row = F.struct(*columns)
    return df.select(*columns, json_text(row, df.select(*columns).schema).alias("json"))
