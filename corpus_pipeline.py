"""The corpus pipeline: five stages from documents to token digests, each the work of one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder
and reads again as the next stage's documents. All but the last keep the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, decontaminate, language_id, near_dedup, toxicity
from strandline.llm.common import fresh_path, held_out, load

#: Documents from this score on are toxic.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC. The model learns from labelled rows of the stage's input
    that are not held out; documents without text, and all without toxic labels, are not toxic. A null doc_id is
    never learned from. Rows are judged one by one, whatever other columns they have."""
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), ~held_out())
    scored, score = toxicity.score(docs, model)
    return scored.where(F.col(score) < TOXIC).select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language: their text has a letter, and the language that fits it best codes it
    about as short as the training texts, by a bound that follows these (language_id.known). Null texts, junk and languages without labels go; short texts have
    a slack and stay. Without labels nothing is known, and nothing is left. Rows are judged one by one."""
    model = language_id.train(language_id.sample(docs, ~held_out()))
    return language_id.known(docs, model).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Documents without words are in
    no group and stay, and so do rows without a doc_id; of rows that repeat a doc_id all stay or all go."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no item of the benchmark contaminates. Null texts and rows without a doc_id stay, an empty
    benchmark drops nothing; rows that repeat a doc_id go together."""
    gone = decontaminate.contamination(docs, load(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number of tokens, digest of its ids, digest of the text decoded from them. Null counts as empty;
    rows that repeat a doc_id have a row each."""
    found, (count, ids, decoded) = bpe.digest(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", F.col(count).alias("n_tokens"), F.col(ids).alias("ids_sha256"), F.col(decoded).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode_tokens),
]

#: Learned models and tokenizers are no SQL; tests hold each stage against its operator and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
