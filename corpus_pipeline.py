"""The training-data pipeline: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalebed.llm import minhash, mixing, pieces, quality, suffix
from shalebed.llm.common import documents, keyed, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The least similarity of near copies, in percent of word shingles; op5 has its own.
NEAR = 80


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of docs, doesn't reject.

    Rows are judged one by one by their text (null: empty), so null and repeated ids change nothing. An empty table
    gives no rows.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of least doc_id, of equal ids the one whose text has the least hash; null ids last.

    Rows without an id or with one that other rows have too are documents of their own. Texts without words have no
    copies and all stay, as null, empty or blank as they are. An empty table gives no rows.
    """
    rows, _ = keyed(docs.select(*COLUMNS), "row")
    near = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), NEAR).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    kept = rows.join(near, "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that a document of smaller doc_id has; a character cut in two goes whole, as does any U+FFFD.

    Every row stays, with its other columns; a null text stays null. Rows without an id, and those whose id another text
    has too, stay as they are. An empty table gives no rows.
    """
    cut = suffix.remove_repeats(docs, carry=("text", "lang", "source", "n_chars"))
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")
    text = F.when(F.size("spans") > 0, left).otherwise(F.col("text"))
    return cut.withColumn("n_chars", F.when(F.size("spans") > 0, F.length(left).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes it wholly or in part; the last one holds only as many words as are left.

    Rows are mixed one by one, also those without an id or with one that others have. Texts without words have nothing
    to take and are left out, as are rows of which the mix takes nothing. An empty table gives no rows.
    """
    rows, _ = keyed(docs.select(*COLUMNS), "row")
    taken = mixing.mix_sources(rows, carry=("row",)).where("taken > 0").select("row", "size", "taken")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    joined = rows.join(taken, "row").withColumn("time", F.explode(F.sequence(F.lit(1), times)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("time") - 1) * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), F.lit(1), words), " ")
    text = F.when(words == F.col("size"), F.col("text")).otherwise(cut)
    return joined.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    """Sampled segmentations of each row's text; the noise follows doc_id, so repeated rows have the same ones. A null or empty text has one, of no pieces."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.sample_segmentations(docs, model)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: The classifier's fit, the minimisers and the sampling have no SQL form; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet in the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/stage-{number}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
