"""Offsets of turns by partition-wise sums, against plain loops."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from rollout_tables.operators.conversations import first_items, masked_conversations, turn_offsets
from rollout_tables.operators.tokens import mask_token_rows


def some_turns(rng):
    rows = []
    for conv in [*range(12), None]:
        for turn in rng.sample(range(60), rng.randrange(1, 40)):
            rows.append((conv, turn, [rng.randrange(5) for _ in range(rng.randrange(4))] if rng.random() < 0.9 else None))
    rows += [(100, t, []) for t in range(5)] + [(101, 0, None), (102, 7, list(range(300))), (103, None, [1, 2]), (103, 0, [3])]
    rows += [(104, 1, [9]), (104, 1, [9]), (104, 1, [8])]
    return rows


def whole(rows):
    by = defaultdict(list)
    for conv, turn, ids in rows:
        by[conv].append((-1 if turn is None else turn, ids is not None, ids or []))
    return {conv: [i for _, _, ids in sorted(x) for i in ids] for conv, x in by.items()}


def test_first_items_equal_the_cut_conversations(spark):
    rows = some_turns(random.Random(3))
    df = spark.createDataFrame(rows, "conv_id long, turn long, ids array<int>").repartition(6)
    want = whole(rows)
    for limit in (1, 7, 1000):
        got = {r["conv_id"]: (r["input_ids"], r["n_ids"]) for r in first_items(df, "ids", limit).collect()}
        assert got == {c: (x[:limit], len(x)) for c, x in want.items()}


def test_masked_rows_equal_those_of_whole_conversations(spark):
    rows = [(c, t, [248045, 3, 198] + [5] * (c + t) if t % 2 else [248045, 2, 198, 7]) for c in range(9) for t in range(c + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, ids array<int>")
    full = spark.createDataFrame(list(whole(rows).items()), "conv_id long, input_ids array<int>")
    columns = ["conv_id", "n_ids", "n_real", "answer_start", "input_ids", "attention_mask", "labels"]
    a, b = (sorted(map(str, x.select(*columns).collect())) for x in (masked_conversations(df, "ids", 24, 0), mask_token_rows(full, 24, 0)))
    assert a == b


def test_a_long_conversation_is_no_large_task(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.array(F.col("id").cast("int")).alias("ids"))
    df = df.unionByName(spark.range(50).select((F.col("id") + 2).cast("int").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.array(F.lit(1)).alias("ids")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        placed = turn_offsets(df, F.size("ids"))
        assert placed.filter("conv_id = 1 AND begin <> turn").isEmpty() and placed.filter("conv_id = 1 AND total <> 200000").isEmpty()
        # no partition, and so no window group, holds much more than its share
        assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < n / 2
        got = first_items(df, "ids", 10).filter("conv_id = 1").first()
        assert got["input_ids"] == list(range(10)) and got["n_ids"] == n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_offsets_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, ids array<int>, begin string")
    assert turn_offsets(df, F.size("ids")).count() == 0 and first_items(df, "ids", 5).count() == 0
