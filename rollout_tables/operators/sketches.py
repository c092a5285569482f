"""Quantiles from mergeable sketches.

A KLL sketch of completion lengths is kept for each step (and category), a few
kilobytes however many completions there are; any report merges those it
covers, so no completion is read again. The rank of an estimated quantile is
off by less than ``rank_error(k)`` (with 99 % confidence); ``reports`` has the
exact form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollout_tables.fixed_values import CHARS_PER_TOKEN

SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """Published bound of a KLL sketch's normalised rank error, single-sided."""
    return 2.296 / k ** 0.9021


def length_sketches(rollouts: DataFrame, by: list[str], k: int = SKETCH_K) -> DataFrame:
    """(by..., n, lengths): a sketch of the completions' character lengths a
    group; a null completion has none (length 0)."""
    chars = F.length(F.coalesce(F.col("completion"), F.lit(""))).cast("long")
    return rollouts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(chars, k).alias("lengths"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of finer groups merged into those of ``by``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("lengths").alias("lengths"))


def sketch_quantiles(sketches: DataFrame, probs: list[float]) -> DataFrame:
    """One row a sketch and quantile: ``p`` and its estimate in characters and
    in approximate tokens."""
    values = F.kll_sketch_get_quantile_bigint("lengths", F.array(*[F.lit(float(p)) for p in probs]))
    others = [c for c in sketches.columns if c != "lengths"]
    out = sketches.select(*others, F.explode(F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), values.alias("chars"))).alias("q"))
    return out.select(*others, F.col("q.p").alias("p"), F.col("q.chars").alias("chars"), (F.col("q.chars") / F.lit(CHARS_PER_TOKEN)).alias("tokens"))
