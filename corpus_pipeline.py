"""Corpus pipeline over ``documents``: drop documents of low quality, keep one
of each group of near-duplicates, cut benchmark passages, replace personal
data, and encode the text. Each stage takes (spark, docs, sf_dir), works on all
that its predecessor kept and is written as Parquet before the next one reads
it; all but the last return the columns of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rollout_tables.llm import decontaminate, pieces, pii, quality, simhash
from rollout_tables.llm.common import scratch, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.replace_entities(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.load())


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("simhash_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("pii_surrogates", replace_personal_data),
    ("sentencepiece", encode_pieces),
]

# the stages hold a trained model, hashes and a tokenizer that SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
