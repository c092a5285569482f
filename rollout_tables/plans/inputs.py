"""The derived inputs every registered query starts from.

Records, prompts, rollouts, position evaluations and token rows are derived
from the driver tables once per session and written as parquet tables under
the shared checkpoint folder (``spark.checkpoint.dir``). Queries then read
those tables, as a production job reads its input tables: scans with column
pruning and filter pushdown, short lineage, and nothing recomputed when an
executor is lost.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from rollout_tables.operators.evals import fen_values, position_children
from rollout_tables.operators.index import EvaluationIndex, open_index, write_index
from rollout_tables.operators.messages import rl_prompts
from rollout_tables.operators.objects import stored_answers
from rollout_tables.session import TABLE_CODEC, checkpoint_dir, compiled
from rollout_tables.sources import fixtures as fx

_WRITTEN: dict[tuple[str, str, str], str] = {}


def _folder(spark: SparkSession, sf_dir: str) -> str:
    tag = re.sub(r"[^A-Za-z0-9_.-]", "_", os.path.abspath(sf_dir).strip("/"))
    return os.path.join(checkpoint_dir(spark), "derived", spark.sparkContext.applicationId, tag)


def _parts(spark: SparkSession) -> int:
    return 2 * spark.sparkContext.defaultParallelism


def _materialise(spark: SparkSession, sf_dir: str, name: str, build, by: str | None = None) -> DataFrame:
    """Written spread over ``by``, or as built: what is derived row by row from
    a table that is spread already is not shuffled again."""
    compiled(spark)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), name)
    path = _WRITTEN.get(key)
    if path is None:
        path = os.path.join(_folder(spark, sf_dir), name)
        df = build() if by is None else build().repartition(_parts(spark), by)
        df.write.mode("overwrite").parquet(path, compression=TABLE_CODEC)
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "records", lambda: fx.records(spark, sf_dir, _parts(spark)))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "prompts", lambda: rl_prompts(records(spark, sf_dir)))


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "evals", lambda: fx.evals(spark, sf_dir, prompts(spark, sf_dir)), "position_key")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "children", lambda: position_children(evals(spark, sf_dir)), "parent_key")


def fens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "fens", lambda: fen_values(evals(spark, sf_dir)), "fen_key")


def index(spark: SparkSession, sf_dir: str) -> EvaluationIndex:
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), "index")
    if key not in _WRITTEN:
        path = os.path.join(_folder(spark, sf_dir), f"index-{uuid.uuid4().hex}")
        write_index(evals(spark, sf_dir), path)
        _WRITTEN[key] = path
    return open_index(spark, _WRITTEN[key])


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "rollouts", lambda: fx.rollouts(spark, sf_dir, _parts(spark)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "answers", lambda: stored_answers(rollouts(spark, sf_dir)))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _materialise(spark, sf_dir, "token_rows", lambda: fx.token_rows(spark, sf_dir), "conv_id")


def prepare(spark: SparkSession, sf_dir: str) -> None:
    """Writes every derived input (used by bench.py to time it apart)."""
    for f in (records, prompts, evals, children, fens, rollouts, token_rows):
        f(spark, sf_dir)
