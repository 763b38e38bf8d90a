"""Named queries of these operators over the whole standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, line_dedup, lm_scoring, merkle, packing, quality_rules, secret_scan, simhash_dedup, spelling, token_counts, token_files,
               vector_codes, warc)

Query = Callable[[SparkSession, str], DataFrame]
# Rows that go to a Python worker at a time. Texts can be long, so this is well below Spark's default of 10,000.
BATCH_ROWS = "500"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(token_files.with_starts(index)).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines_kept"), "n_lines_gone", "text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "votes", "p_good")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"),
                                      public_tokenizers.PATTERN, decode=True)
    return found.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_dedup, op2_merkle, op3_secret_scan, op4_token_counts, op5_token_files, op6_warc, op7_line_dedup, op8_packing,
    op9_quality_rules, op10_byte_bpe, op11_lm_scoring, op12_spelling_variants, op13_vector_codes)}
# SQL for those that it can express
SQL: dict[str, str] = {}
