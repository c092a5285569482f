"""Exact sizes, disjoint and complete, same as a global rank."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollout_tables.fixed_values import SPLITS_3WAY, SPLITS_4WAY
from rollout_tables.operators.ranks import numbered
from rollout_tables.operators.splits import assign_splits, borders, size_report, split_3way, split_4way


def _global_order(ids, seed=42):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n,sizes", [(1000, [700, 200, 100]), (90, [63, 18, 9]), (7, [6, 1, 0])])
def test_3way_sizes(spark, n, sizes):
    out = split_3way(spark.range(n).withColumnRenamed("id", "rid"), "rid")
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert [got.get(s, 0) for s in ("sft_train", "rl", "test")] == sizes


def test_4way_sizes_remainder(spark):
    # floors 55/5/17/8 of 87, remainder 2 goes to the first split
    out = split_4way(spark.range(87).withColumnRenamed("id", "rid"), "rid")
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert [got[s] for s in ("sft_train", "sft_val", "rl", "test")] == [57, 5, 17, 8]


def test_rank_equals_global_order(spark):
    ids = list(range(0, 3000, 3))
    out = split_3way(spark.createDataFrame([(i,) for i in ids], "rid long"), "rid")
    ranked = {r["rid"]: r["split_rank"] for r in out.collect()}
    assert [ranked[i] for i in _global_order(ids)] == list(range(1, len(ids) + 1))


def test_partitioning_and_order_do_not_matter(spark):
    base = spark.range(500).withColumnRenamed("id", "rid")
    a = {tuple(r) for r in split_4way(base.repartition(1), "rid").collect()}
    b = {tuple(r) for r in split_4way(base.orderBy(F.desc("rid")).repartition(13), "rid").collect()}
    assert a == b


def test_disjoint_and_complete(spark):
    out = split_4way(spark.range(321).withColumnRenamed("id", "rid"), "rid").cache()
    assert out.count() == 321 and out.select("rid").distinct().count() == 321
    for s in ("sft_train", "sft_val", "rl", "test"):
        part = out.filter(F.col("split") == s).select("rid")
        rest = out.filter(F.col("split") != s).select("rid")
        assert part.intersect(rest).count() == 0


def test_size_report(spark):
    rep = size_report(split_3way(spark.range(399).withColumnRenamed("id", "rid"), "rid"))
    got = {r["split"]: (r["n"], r["split_order"]) for r in rep.collect()}
    assert got == {"sft_train": (281, 0), "rl": (79, 1), "test": (39, 2)}


def test_no_single_partition_window_over_rows(spark):
    plan = split_3way(spark.range(100).withColumnRenamed("id", "rid"), "rid")._jdf.queryExecution() \
        .executedPlan().toString()
    # the row_number window is partitioned by bucket; the only single-partition
    # window runs over the aggregated bucket counts
    assert "row_number() windowspecdefinition(_bucket" in plan
    assert plan.count("SinglePartition") <= 2


def test_more_buckets_same_ranks(spark):
    base = spark.range(300).withColumnRenamed("id", "rid")
    a = {r["rid"]: r["split_rank"] for r in split_3way(base, "rid").collect()}
    b = {r["rid"]: r["split_rank"] for r in split_3way(base, "rid", bucket_chars=5).collect()}
    assert a == b


def _expected(ids, ratios, seed=42):
    """How many rows of each id each split holds."""
    order = sorted(ids, key=lambda i: "g" if i is None else hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    floors = [int(len(ids) * r) for _, r in ratios]
    sizes = [floors[0] + len(ids) - sum(floors), *floors[1:]]
    names = [n for (n, _), k in zip(ratios, sizes) for _ in range(k)]
    return Counter(zip(order, names))


THIRD_NULL = [None] * 100 + list(range(200))
ONE_HOT = [7] * 150 + list(range(100)) * 2 + [None]


@pytest.mark.parametrize("with_rank", [True, False])
@pytest.mark.parametrize("ids", [THIRD_NULL, ONE_HOT, [None] * 9, [5] * 10, [1], [], list(range(1000))])
def test_null_and_repeated_ids_keep_rows_and_sizes(spark, ids, with_rank):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "rid long, row int").repartition(5)
    for ratios in (SPLITS_3WAY, SPLITS_4WAY):
        got = assign_splits(df, "rid", ratios, with_rank=with_rank).collect()
        assert Counter((r["rid"], r["split"]) for r in got) == _expected(ids, ratios)
        assert sorted(r["row"] for r in got) == list(range(len(ids)))
        if with_rank:
            assert sorted(r["split_rank"] for r in got) == list(range(1, len(ids) + 1))


def test_borders_by_levels_equal_a_sort(spark, monkeypatch):
    ids = list(range(4000)) + [3] * 50
    df = spark.createDataFrame([(i,) for i in ids], "rid long")
    order = sorted(hashlib.md5(f"42:{i}".encode()).hexdigest() for i in ids)
    ends = [2835, 3645, 4050]
    for levels in ((4, 8, 32), (1, 2, 32), (1, 3, 32)):
        monkeypatch.setattr("rollout_tables.operators.splits.RADIX_CHARS", levels)
        got = borders(df, "rid", SPLITS_3WAY)
        assert [(b.rank, b.hash, b.before, b.count) for b in got] == [
            (r, order[r - 1], order.index(order[r - 1]), order.count(order[r - 1])) for r in ends]


def test_unranked_rows_pass_no_exchange(spark, tmp_dir):
    spark.range(5000).withColumnRenamed("id", "rid").write.parquet(f"{tmp_dir}/r")
    out = assign_splits(spark.read.parquet(f"{tmp_dir}/r"), "rid", with_rank=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_existing_split_column_is_replaced(spark):
    df = spark.range(50).select(F.col("id").alias("rid"), F.lit("old").alias("split"))
    for with_rank in (True, False):
        out = assign_splits(df, "rid", with_rank=with_rank)
        assert out.columns.count("split") == 1 and out.filter("split = 'old'").isEmpty()


def test_numbered_counts_on_over_partitions(spark):
    df = spark.range(1000).repartition(7).filter("id % 3 = 0")
    assert sorted(r["nr"] for r in numbered(df, "nr").collect()) == list(range(1, 335))
    assert numbered(df.limit(0), "nr").count() == 0
