"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollout_tables.llm.common import crc_of_id

TRAIN_ROWS = 20_000
TRAIN_CHARS = 1_000_000


def training_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, y) of at most ``train_rows`` labelled ids, the smallest by a hash
    of the id, none of them from the held-out fold (crc32 of the id as text
    modulo ``folds`` equal to ``held``). Of an id labelled more than once the
    mean label, rounded up, holds. Texts of more than ``TRAIN_CHARS`` characters
    stay out of the sample, so its size is bounded. The id table is the only side broadcast."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("t_id"), F.col(label).cast("double").alias("y")).filter("t_id is not null and y is not null")
              .filter(crc_of_id("t_id") % folds != held).groupBy("t_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    sample = marked.orderBy(F.xxhash64("t_id"), "t_id").limit(train_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("t_id")).filter(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).select("doc_id", "text", "y")
