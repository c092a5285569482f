"""The evaluation table stored for lookups.

A job of its own writes the evaluations as three bucketed and sorted parquet
tables: by position, the successors of each position, and by FEN. A join to
one of them shuffles only the rows that look something up, into the table's
buckets; the evaluations, the larger side once they cover a corpus of games,
are read in place and in order.

The start position, where every empty or invalid move list lands, is still
read by a scalar subquery and stays out of the joins. What a bucketed side
costs: Spark splits a hot key's partition only where both sides are shuffled,
so with another position in a large share of all prompts, join to the plain
table instead.

A folder holds one index and says itself how it is bucketed, so any session
can open it; the tables are registered in the session's catalog under names
taken from the folder, and dropping them there leaves the files.
"""

from __future__ import annotations

import hashlib
import os
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.operators.evals import EVAL_COLUMNS, fen_values, position_children, scored_evals

KEYS = {"positions": "position_key", "children": "parent_key", "fens": "fen_key"}


class EvaluationIndex(NamedTuple):
    evals: DataFrame
    children: DataFrame
    fens: DataFrame


def _name(path: str, part: str) -> str:
    return f"evaluation_index_{hashlib.md5(path.encode()).hexdigest()[:16]}_{part}"


def write_index(evals: DataFrame, path: str, mate: str = "as_cp", buckets: int | None = None) -> None:
    """Writes the index of ``evals`` into the folder ``path``, which must not
    hold one. ``buckets`` is ``spark.sql.shuffle.partitions`` unless given;
    ``mate`` is that of the rewards to be computed (F8). A position that
    occurs twice in ``evals`` is an error of the table, as for the lookups."""
    spark = evals.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = scored_evals(evals, mate).select("position_key", *EVAL_COLUMNS)
    for part, df in (("positions", scored), ("children", position_children(scored)), ("fens", fen_values(scored))):
        key, name = KEYS[part], _name(path, part)
        # one task a bucket: the hash that deals rows to tasks is that of the buckets
        spread = df.repartition(buckets, key)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        (spread.write.format("parquet").option("path", os.path.join(path, part)).bucketBy(buckets, key).sortBy(key)
         .mode("errorifexists").saveAsTable(name))
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(mate).alias("mate")).coalesce(1).write.parquet(os.path.join(path, "info"))


def open_index(spark: SparkSession, path: str) -> EvaluationIndex:
    """The tables of an index, as ``score_rollouts`` takes them."""
    buckets = spark.read.parquet(os.path.join(path, "info")).first()["buckets"]
    found = []
    for part, key in KEYS.items():
        name, folder = _name(path, part), os.path.join(path, part)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema.fields)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
                      f"LOCATION '{folder}'")
        found.append(spark.table(name))
    return EvaluationIndex(*found)
