"""Numbering the rows of a table without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollout_tables.session import materialise


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number from 1, without gaps, in column ``name``; which
    row gets which is not defined.

    The rows are written with their partition and their place in it, which
    fixes both; a partition's rows then count on from those of the partitions
    before it. Only that table of partitions is windowed."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = materialise(df.withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_before"))
    return rows.join(before, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
