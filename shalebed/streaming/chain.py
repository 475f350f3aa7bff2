"""Record pipelines: linear steps over ordered records, in batch or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def run(df: DataFrame, *steps: Step) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def drop_types(*types: str) -> Step:
    return lambda df: df.where(~F.col("type").isin(*types))


def drop_listed(listed: DataFrame) -> Step:
    """Drop writes at listed (object, offset)."""
    return lambda df: df.join(listed.select("object", "offset", F.lit("WRITE").alias("type")), ["object", "offset", "type"], "left_anti")


def resolve_references(df: DataFrame) -> DataFrame:
    """WRITE_BYREF rows get the payload of the last earlier WRITE at (ref_object, ref_offset) and become WRITE."""
    # One sweep over each place in order of seq: what a reference asks for is the last write before it.
    reference = F.col("type") == "WRITE_BYREF"
    place = [F.when(reference, F.col(f"ref_{c}")).otherwise(F.col(c)) for c in ("object", "offset")]
    before = W.partitionBy(*place).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("type") == "WRITE", F.struct("payload")), ignorenulls=True).over(before)
    found = df.withColumn("_p", F.when(reference, last))
    return found.withColumn("payload", F.coalesce("_p.payload", "payload")).withColumn("type", F.when(F.col("_p.payload").isNotNull(), "WRITE").otherwise(F.col("type"))).drop("_p")


def apply_writes(df: DataFrame) -> DataFrame:
    """The image after all records: the last write of each (object, offset) that no later FREE of it removed."""
    last = df.where("type in ('WRITE', 'FREE')").groupBy("object", "offset").agg(F.max_by(F.struct("type", "payload"), "seq").alias("r"))
    return last.where("r.type = 'WRITE'").select("object", "offset", F.col("r.payload").alias("payload"))


def statistics(df: DataFrame) -> DataFrame:
    """Records and payload bytes by type, and of all (type null)."""
    return df.rollup("type").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("long").alias("payload_bytes"))


def event_counts(spark: SparkSession, path: str, out: str, checkpoint: str, span: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by time window and type of Parquet event files arriving in path: all there is now, then stops.

    Windows tumble, or slide by `slide`. Each batch writes the windows that it changed to a folder of its number in
    `out`, again if it comes again, and the latest batch decides. The watermark bounds the state: events over an hour
    older than the newest seen are dropped.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", span, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.col("w.start").alias("start"), "event_type", "n", "total").write.mode("overwrite").parquet(f"{out}/batch={number}")

    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("start", "event_type", "r.*")


def sessions(spark: SparkSession, path: str, out: str, checkpoint: str, gap: str) -> DataFrame:
    """Sessions of each user in Parquet event files arriving in path: events no further apart than `gap`; those that the watermark has closed."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    flat = counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(out)
