"""Conversations of any length, turn by turn.

Where only the first ``limit`` tokens (or characters) of a conversation are
used, the turns beyond them need not be gathered. A turn's offset is the sum of
the sizes before it: turns are dealt by ranges of (conversation, turn), so a
long conversation lies over several partitions, and written with their
partition number; sizes are summed within each partition, and each partition's
part of a conversation continues where those before it end. Only turns that
begin before the limit are then collected, so the largest group has ``limit``
of them, whatever the conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollout_tables.operators.tokens import mask_token_rows
from rollout_tables.session import materialise


def turn_offsets(turns: DataFrame, size: Column, key: str = "conv_id", order: list[str] | None = None) -> DataFrame:
    """``turns`` with ``size`` (of the turn), ``begin`` (sum of the sizes of the
    conversation's earlier turns) and ``total`` (of all its turns). Turns are
    ordered by ``order`` (``turn``, then all other columns), nulls first; null
    sizes count as 0. Columns of these names are replaced."""
    order = order or ["turn", *[c for c in turns.columns if c not in (key, "turn", "size", "begin", "total")]]
    kept = [c for c in turns.columns if c not in ("size", "begin", "total")]
    sized = turns.select(*kept, F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    dealt = sized.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (key, *order)])
    rows = materialise(dealt.withColumn("_part", F.spark_partition_id()), "turns")
    parts = rows.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_in")).agg(F.sum("size").alias("_sum"))
    whole = Window.partitionBy("_key")  # one row a partition that holds turns of the conversation
    before = whole.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "total": F.sum("_sum").over(whole)})
    inside = Window.partitionBy(key, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = local.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_in")))
    return joined.select(*kept, "size", (F.col("_before") + F.col("_local")).alias("begin"), "total")


def first_items(turns: DataFrame, items: str, limit: int, key: str = "conv_id", order: list[str] | None = None,
                out: str = "input_ids", total: str = "n_ids") -> DataFrame:
    """The first ``limit`` entries of each conversation's arrays ``items``, one
    after another (C1), and how many there are in all. A conversation without
    entries gives an empty array."""
    ids = F.coalesce(F.col(items), F.array().cast(turns.schema[items].dataType))
    placed = turn_offsets(turns, F.size(ids), key, order)
    # a conversation's first turn always stays, so that none is lost
    near = placed.filter((F.col("begin") < limit) & ((F.col("size") > 0) | (F.col("total") == 0)))
    near = near.select(key, "total", "begin", F.slice(ids, F.lit(1), (F.lit(limit) - F.col("begin")).cast("int")).alias("_items"))
    # turns without entries tell nothing but that the conversation is there
    empty = near.filter(F.col("total") == 0).select(key).distinct().select(
        key, F.array().cast(turns.schema[items].dataType).alias(out), F.lit(0).alias(total))
    found = near.filter(F.col("total") > 0).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("begin", "_items"))).alias("_all"), F.any_value("total").cast("int").alias(total))
    return found.select(key, F.flatten(F.col("_all._items")).alias(out), total).unionByName(empty)


def masked_conversations(turns: DataFrame, items: str, max_len: int, pad_id: int, rule: str = "answer", key: str = "conv_id",
                         order: list[str] | None = None) -> DataFrame:
    """C1-C4 from turns with token arrays: as ``mask_token_rows`` over the
    whole conversations, with ``n_ids`` their full length."""
    rows = first_items(turns, items, max_len, key, order, total="_total")
    return mask_token_rows(rows, max_len, pad_id, rule).withColumn("n_ids", F.col("_total")).drop("_total")
