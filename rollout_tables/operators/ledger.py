"""A growing table of evaluations (F9, F10): batches are merged in, and work
lists are compared with it, reading only what they touch.

Rows are kept by (kind, key): a position by its moves, a FEN by itself. The
folder is partitioned by a hash of both into a fixed number of parts
(``bucket``), so a batch knows which parts it touches. These are read, merged
and replaced by dynamic partition overwrite; all others stay as they are,
files and all. A merge that is run again after a failure gives the same table,
as a later batch only replaces rows of its own keys.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.session import materialise

BUCKETS = 256
KEY = ["kind", "key"]


def ledger_rows(evals: DataFrame) -> DataFrame:
    """Evaluations with their ``kind`` and ``key``: those of a position, else
    those of a FEN alone. Rows with neither are left out."""
    kind = F.when(F.col("position_key").isNotNull(), F.lit("position")).when(F.col("fen").isNotNull(), F.lit("fen"))
    return evals.select(kind.alias("kind"), F.coalesce("position_key", "fen").alias("key"), *evals.columns).filter(F.col("kind").isNotNull())


def _with_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))


def _touched(rows: DataFrame) -> list[int]:
    """The parts that some rows belong to: at most as many as there are."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def merge(path: str, evals: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Merges a batch of evaluations into the ledger at ``path`` (begun when
    there is none) and returns the parts it replaced. The batch's row of a key
    replaces the ledger's; of several in one batch one stays (the largest as a
    struct). ``buckets`` must stay what it was at the beginning."""
    spark = evals.sparkSession
    rows = ledger_rows(evals)
    rest = [c for c in rows.columns if c not in KEY]
    # top_moves and the like are compared as they are, by value
    batch = rows.groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("_row")).select(*KEY, "_row.*")
    batch = materialise(_with_bucket(batch, buckets), "ledger-batch")
    parts = _touched(batch)
    if not parts:
        return []
    merged = batch
    if _exists(spark, path):
        old = spark.read.parquet(path).filter(F.col("bucket").isin(parts))
        merged = batch.unionByName(old.join(batch.select(*KEY), KEY, "left_anti"))
        merged = materialise(merged, "ledger-merged")  # the parts read are those replaced
    (merged.repartition(len(parts), "bucket").sortWithinPartitions("bucket", *KEY).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
    return parts


def missing(path: str, work: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The (kind, key) rows of a work list that the ledger lacks; only the
    parts that the list touches are read."""
    spark = work.sparkSession
    wanted = materialise(_with_bucket(work.select(*KEY).distinct(), buckets), "ledger-work")
    if not _exists(spark, path):
        return wanted.drop("bucket")
    known = spark.read.parquet(path).filter(F.col("bucket").isin(_touched(wanted))).select(*KEY)
    return wanted.drop("bucket").join(known, KEY, "left_anti")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole ledger, as the evaluation table that the lookups take."""
    return spark.read.parquet(path).drop("bucket")


def ledger_path(folder: str) -> str:
    return os.path.join(folder, "evaluations")
