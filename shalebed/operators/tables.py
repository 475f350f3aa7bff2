"""Key/value tables as rows (key, value): reads, changes, cursors in hash order, shape; and attribute layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(table: DataFrame, wanted: DataFrame, key: str, value: str, normal=None) -> DataFrame:
    """wanted (key) with value, null where the table has no such key.

    With normal (a function of a column), keys are equal if their normal forms are; of several the least key counts.
    """
    form = normal or (lambda c: c)
    held = table.groupBy(form(F.col(key)).alias("_form")).agg(F.min_by(value, key).alias(value))
    return wanted.select(key).withColumn("_form", form(F.col(key))).join(held, "_form", "left").select(key, value)


def reverse(table: DataFrame, wanted: DataFrame, key: str, value: str, mask: int = -1) -> DataFrame:
    """wanted (value) with the least key whose value, under the mask, is that one; null if there is none."""
    masked = lambda c: F.col(c).bitwiseAND(F.lit(mask).cast("long"))
    held = table.groupBy(masked(value).alias("_v")).agg(F.min(key).alias(key))
    return wanted.select(value, masked(value).alias("_v")).join(held, "_v", "left").select(value, key)


def add(table: DataFrame, new: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """The table with new rows, and those of new that it refuses for their key is taken."""
    taken = new.join(table.select(key), key, "left_semi").select(key, value)
    return table.select(key, value).unionByName(new.join(table.select(key), key, "left_anti").select(key, value)), taken


def increment(table: DataFrame, deltas: DataFrame, key: str, value: str) -> DataFrame:
    """The table with deltas added to the values of their keys; a key that is not there begins at 0, one that comes to 0 goes."""
    both = table.select(key, value).unionByName(deltas.select(key, value))
    return both.groupBy(key).agg(F.sum(value).alias(value)).where(F.col(value) != 0)


def hashed(key: Column | str) -> Column:
    """The hash by which a cursor goes: 64 bits as sixteen hexadecimal digits."""
    return F.substring(F.md5((F.col(key) if isinstance(key, str) else key).cast("string")), 1, 16)


def page(table: DataFrame, key: str, cursor: tuple[str, object] | None, n: int) -> DataFrame:
    """The next n rows after a cursor (hash, key) in the order of both, with column hash: the last row's pair is the next cursor.

    Only the least n are kept by each task, so no page sorts the table.
    """
    rows = table.withColumn("hash", hashed(key))
    if cursor is not None:
        rows = rows.where((F.col("hash") > cursor[0]) | ((F.col("hash") == cursor[0]) & (F.col(key) > F.lit(cursor[1]))))
    return rows.orderBy("hash", key).limit(n)


def shape(table: DataFrame, key: str, bits: int, chunk: int = 24) -> DataFrame:
    """what, size and n: leaves by the power of two of their entries, and entries by the chunks that their keys take.

    A leaf holds the keys whose hashes begin with the same bits; a key takes as many chunks of bytes as it needs.
    """
    prefix = F.floor(F.conv(F.substring(hashed(key), 1, 8), 16, 10).cast("long") / F.lit(1 << (32 - bits)))
    leaves = table.groupBy(prefix.alias("_leaf")).agg(F.count("*").alias("n"))
    of_leaves = leaves.groupBy((F.length(F.bin("n")) - 1).cast("long").alias("size")).agg(F.count("*").alias("n")).select(F.lit("leaf").alias("what"), "size", "n")
    chunks = F.ceil(F.octet_length(F.col(key).cast("string")) / chunk).cast("long")
    of_entries = table.groupBy(chunks.alias("size")).agg(F.count("*").alias("n")).select(F.lit("entry").alias("what"), "size", "n")
    return of_leaves.unionByName(of_entries)


def layouts(objects: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Objects with the number of their layout, and the layouts: the sets of attributes that are not null, shared by hash."""
    present = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns)))
    numbered = objects.withColumn("attributes", present).withColumn("layout", F.substring(F.md5(F.array_join("attributes", ",")), 1, 8))
    return numbered.drop("attributes"), numbered.groupBy("layout", "attributes").agg(F.count("*").alias("objects"))


def attributes(objects: DataFrame, names: list[str]) -> DataFrame:
    """object, name and value (text) of those of the named attributes that an object has."""
    return objects.select("object", *(F.col(n).cast("string").alias(n) for n in names)).unpivot(["object"], names, "name", "value").where("value is not null")
