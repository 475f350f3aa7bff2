"""The queries opN_<name> of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalebed.llm import chunks, huffman, imatch, lattice, maxent, minhash, mixing, pieces, quality, suffix
from shalebed.llm.common import documents


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.remove_repeated_chunks(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "text", "kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    found = pieces.sample_segmentations(documents(spark, sf_dir), model)
    return found.select("doc_id", "rank", "n_tokens", "log_prob", "perturbed", "inclusion", F.crc32("ids").alias("ids_crc32"), "round_trip")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.summary(suffix.remove_repeats(documents(spark, sf_dir)))


def op10_token_id_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = huffman.id_files(documents(spark, sf_dir), tokenizer, end=2)
    return ids.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_mix_sources": op3_mix_sources,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_token_id_files": op10_token_id_files,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.c + b.c - i)),
r(doc_id, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT doc_id, min(y) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
}
