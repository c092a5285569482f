"""Token-array job: truncation, padding, answer start and label mask
(C1-C4) plus its audit (C5). Narrow: array functions per row, no shuffle."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollout_tables.fixed_values import IGNORE_INDEX
from rollout_tables.functions import tokens as T


def mask_token_rows(df: DataFrame, max_len: int, pad_id: int, rule: str = "answer",
                    ids_col: str = "input_ids") -> DataFrame:
    """Adds ``n_ids`` (before truncation), ``n_real``, ``answer_start`` and
    replaces ``input_ids`` with the truncated, padded ids; adds
    ``attention_mask`` and ``labels``."""
    staged = df.withColumn("n_ids", F.size(ids_col)).withColumn(ids_col, T.truncate(F.col(ids_col), max_len))
    staged = staged.withColumn("n_real", F.size(ids_col)).withColumn(
        ids_col, T.pad(F.col(ids_col), max_len, pad_id))
    staged = staged.withColumn("answer_start", T.answer_start(F.col(ids_col), rule, F.col("n_real")))
    return (staged.withColumn("attention_mask", T.attention_mask(F.col(ids_col), F.col("n_real")))
            .withColumn("labels", T.mask_labels(F.col(ids_col), F.col("answer_start"))))


def token_audit(masked: DataFrame, max_len: int) -> DataFrame:
    """Rows truncated, rows without an answer start, trained tokens."""
    trained = F.size(F.filter("labels", lambda x: x != IGNORE_INDEX))
    return masked.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("n_ids") > max_len).alias("n_truncated"),
        F.count_if(F.col("answer_start").isNull()).alias("n_without_answer"),
        F.sum(trained).cast("long").alias("trained_tokens"),
        F.avg(trained).alias("mean_trained_tokens"))


def tokenize(df: DataFrame, tokenizer, text_col: str = "text", out_col: str = "input_ids") -> DataFrame:
    """K2: token ids from a user tokenizer (``list[str] -> list[list[int]]``),
    run per Arrow batch in a pandas UDF; the tokenizer itself is an input,
    not part of this package. The result feeds ``mask_token_rows``."""
    @F.pandas_udf("array<int>")
    def _ids(texts: pd.Series) -> pd.Series:
        return pd.Series(list(tokenizer(texts.fillna("").tolist())))

    return df.withColumn(out_col, _ids(F.col(text_col)))
