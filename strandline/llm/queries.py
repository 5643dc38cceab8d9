"""The queries of this package for __spark_entry__.py: thin adapters with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, embedding_dedup, filter_audit, hard_negatives, language_id, license_scan, line_dedup, near_dedup, oracles, token_files, toxicity, url_filter
from strandline.llm.common import fresh_path, held_out, load


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(load(spark, sf_dir, "pages"), url_filter.RULES)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    token_files.write_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=0)
    return token_files.read_digests(spark, folder)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found, (count, ids, decoded) = bpe.digest(docs, public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.col(count).alias("n_tokens"), F.col(ids).alias("ids_sha256"), F.col(decoded).alias("decoded_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(load(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), ~held_out())
    found, score = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col(score).alias("score"), (F.col(score) >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found, (count, fitting) = bpe.count_within(docs, public_tokenizers.path("word_bpe_49k.json"), limit)
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", bytes_.alias("n_bytes"), F.col(count).alias("n_tokens"), (F.col(count) > limit).alias("over_limit"), F.col(fitting).alias("fitting_bytes"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language_id.train(language_id.sample(docs, ~held_out()))
    found, lang, score = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(load(spark, sf_dir, "embeddings"), label)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, (lines, dropped, kept) = line_dedup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(lines).alias("n_lines"), F.col(dropped).alias("n_dropped"), F.sha2(F.col(kept).cast("binary"), 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = (
    op1_url_filter, op2_token_files, op3_bpe, op4_embedding_dedup, op5_license_scan, op6_toxicity, op7_token_counts, op8_near_dedup, op9_language_id, op10_decontaminate,
    op11_hard_negatives, op12_line_dedup, op13_filter_audit,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
