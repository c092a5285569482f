"""PARSE job: completion text to typed prediction columns.

Narrow: a few chained projections over the rollouts, no shuffle. The JSON
object is parsed once per row into a map column, every label is read from
it, then the map is dropped so it never travels through a later shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.functions import completions as C

PARSED_COLUMNS = ["json_state", "pred_move", "pred_advantage", "pred_score", "pred_missing", "pred_fens",
                  "think_tokens"]


def completion_of(rollouts: DataFrame, completion_col: str) -> Column:
    """The completion as text."""
    return C.completion_text(F.col(completion_col), rollouts.schema[completion_col].dataType)


def _text(rollouts: DataFrame, completion_col: str, strip_think: bool) -> Column:
    text = completion_of(rollouts, completion_col)
    return C.without_think(text) if strip_think else text


def parse_completions(rollouts: DataFrame, completion_col: str = "completion", strip_think: bool = False) -> DataFrame:
    """Adds ``json_state``, ``pred_move``, ``pred_advantage``, ``pred_score``,
    ``pred_missing`` (array), ``pred_fens`` (array) and ``think_tokens``.
    ``strip_think`` reads the answer outside the reasoning block only (Q9).

    Do not ``filter`` directly on these columns: the optimizer pushes a
    filter below the projections and inlines the parse into its condition.
    Select rows by category before parsing, and use ``when`` (or an explode
    of an optional value) after it."""
    df = C.parse(rollouts.withColumn("_c", _text(rollouts, completion_col, strip_think)), "_c").drop("_c")
    return _whole_think(df, rollouts, completion_col) if strip_think else df


def scan_completions(rollouts: DataFrame, completion_col: str = "completion", strip_think: bool = False) -> DataFrame:
    """First half of the parse, where the completions are scanned: the short
    columns that ``label_by_category`` needs, in place of the completion."""
    df = C.scan(rollouts.withColumn("_c", _text(rollouts, completion_col, strip_think)), "_c").drop("_c")
    df = _whole_think(df, rollouts, completion_col) if strip_think else df
    return df.drop(completion_col)


def _whole_think(df: DataFrame, rollouts: DataFrame, completion_col: str) -> DataFrame:
    return df.withColumn("think_tokens", C.think_tokens(completion_of(rollouts, completion_col)))


def label_by_category(scanned: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Second half, once ``category`` is known: ``json_state`` and the labels
    that the rule of the row's own category reads (those of ``categories``, of
    all by default); labels of other rules are null."""
    return C.label(scanned, [c for c in C.CATEGORY_KEYS if categories is None or c in categories])
