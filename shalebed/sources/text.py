"""Text tables of counters, and sinks for line protocol, tabs and flat images."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shalebed.functions.scalars import escape_tag


def counter_table(spark: SparkSession, path: str, header: int = 0) -> DataFrame:
    """Rows of whitespace-separated tables whose header is line `header` of each file, as strings, and the file's name.

    Such a file is a few pages; each is read whole so that its own header names its values. Columns are those of the
    first file; what another lacks is null.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    files = files.withColumn("names", F.split(F.trim(F.col("l")[header]), r"\s+"))
    first = files.orderBy("file").first()
    rows = files.select("file", "names", F.posexplode("l").alias("at", "text")).where((F.col("at") > header) & (F.trim("text") != ""))
    # Short rows are filled with nulls.
    values = F.split(F.trim("text"), r"\s+")
    cells = rows.select("file", F.map_from_arrays("names", F.transform("names", lambda n, i: F.get(values, i))).alias("m"))
    return cells.select("file", *(F.col("m")[n].alias(n) for n in (first["names"] if first else [])))


def named_counters(spark: SparkSession, path: str, header: int = 1) -> DataFrame:
    """file, name and value (long) of tables with columns name, type and data; other types give null."""
    return counter_table(spark, path, header).select("file", "name", F.expr("try_cast(data AS long)").alias("value"))


def line_protocol(measurement: str, tags: list[str], fields: list[str], at: Column) -> Column:
    """One line: measurement and tags, whole-number fields, time in nanoseconds; null tags and fields are left out."""
    keyed = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), escape_tag(F.col(c).cast("string")))) for c in tags]
    numbers = [F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"), F.lit("u"))) for c in fields]
    return F.concat_ws(" ", F.concat_ws(",", F.lit(measurement), *keyed), F.concat_ws(",", *numbers), (F.unix_micros(at) * 1000).cast("string"))


def write_lines(df: DataFrame, path: str, measurement: str, tags: list[str], fields: list[str], at: Column) -> None:
    df.select(line_protocol(measurement, tags, fields, at).alias("value")).write.text(path)


def write_tabs(df: DataFrame, path: str, columns: list[str]) -> None:
    """Values by tabs without a header, a dash for null."""
    df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)).alias("value")).write.text(path)


def write_image(writes: DataFrame, path: str, size: int, parts: int = 8) -> None:
    """A flat file of `size` bytes with each payload at its offset; the rest is a hole. Writes do not overlap.

    path is in a folder that all tasks share. Tasks write separate ranges, and a task that runs again writes the same.
    """
    with open(path, "wb") as f:
        f.truncate(size)

    def put(rows: Iterator[Row]) -> None:
        f = os.open(path, os.O_WRONLY)
        try:
            for r in rows:
                os.pwrite(f, bytes(r["payload"]), r["offset"])
        finally:
            os.close(f)

    writes.select("offset", "payload").repartitionByRange(parts, "offset").sortWithinPartitions("offset").foreachPartition(put)
