"""Write splits, read them back with partition pruning, resolve names."""

import pytest

from rollout_tables.operators.splits import split_4way
from rollout_tables.sources.datasets import read_dataset, rl_train_split, sft_train_split, val_split, \
    write_splits


def test_round_trip_and_resolution(spark, tmp_dir):
    df = split_4way(spark.range(200).withColumnRenamed("id", "rid"), "rid")
    path = f"{tmp_dir}/splits"
    write_splits(df, path)
    back = read_dataset(spark, path)
    assert back.count() == 200 and sorted(r[0] for r in back.select("split").distinct().collect()) == ["rl", "sft_train", "sft_val", "test"]
    train = sft_train_split(back, "sft_train")
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString() \
        or "split#" in train._jdf.queryExecution().executedPlan().toString()
    assert train.count() == 128
    with pytest.raises(ValueError):
        sft_train_split(back, "train")
    with pytest.raises(ValueError):
        rl_train_split(back, "train")
    rl, has_eval = rl_train_split(back, "rl")
    assert rl.count() == 40 and has_eval
    assert val_split(back, "validation", ("validation",)) is None
    assert val_split(back, "sft_val").count() == 12


def test_whole_dataset_without_splits(spark):
    df = spark.range(10)
    assert sft_train_split(df, "train").count() == 10
    whole, has_eval = rl_train_split(df, "train")
    assert whole.count() == 10 and not has_eval


def test_train_part_is_taken(spark, tmp_dir):
    df = spark.createDataFrame([(1, "train"), (2, "other")], "x long, split string")
    write_splits(df, f"{tmp_dir}/d")
    assert [r["x"] for r in read_dataset(spark, f"{tmp_dir}/d").collect()] == [1]


def test_other_source_format(spark, tmp_dir):
    spark.createDataFrame([(1, "a"), (2, "b")], "record_id long, task string").write.json(f"{tmp_dir}/j")
    df = read_dataset(spark, f"{tmp_dir}/j", fmt="json")
    assert sorted(r["record_id"] for r in df.collect()) == [1, 2]
