"""The evaluation ledger: one row a key, untouched parts stay as they are."""

import os

from pyspark.sql import functions as F

from rollout_tables.operators import ledger as L
from rollout_tables.operators.evals import EVAL_SCHEMA


def evals(spark, rows):
    return spark.createDataFrame([(k, f, "cp", v, "e2e4", None) for k, f, v in rows], EVAL_SCHEMA)


def files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def content(spark, path):
    rows = [(r["kind"], r["key"], r["eval_value"]) for r in L.read(spark, path).collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return sorted(rows)


def test_two_batches_leave_one_row_a_key_and_other_parts_alone(spark, tmp_dir):
    path = L.ledger_path(tmp_dir)
    first = [(f"k{i}", f"f{i}", i) for i in range(200)]
    assert len(L.merge(path, evals(spark, first), buckets=16)) == 16
    before = files(path)
    # new values, a key twice, a FEN by itself, a row without either
    parts = L.merge(path, evals(spark, [("k3", "f3", -1), ("k3", "f3", -5), (None, "alone", 7), (None, None, 9)]), buckets=16)
    assert 1 <= len(parts) <= 2
    after = files(path)
    same = {f for f in before if not any(f"bucket={p}/" in f for p in parts)}
    assert same and all(after[f] == before[f] for f in same)
    assert {f for f in after if f not in same} and all(any(f"bucket={p}/" in f for p in parts) for f in after if f not in same)
    want = sorted([("position", k, -1 if k == "k3" else v) for k, _, v in first] + [("fen", "alone", 7)])
    assert content(spark, path) == want
    L.merge(path, evals(spark, [("k3", "f3", -1)]), buckets=16)  # again: the same table
    assert content(spark, path) == want


def test_merging_nothing_and_a_first_batch(spark, tmp_dir):
    path = L.ledger_path(tmp_dir)
    assert L.merge(path, evals(spark, []).limit(0)) == []
    work = spark.createDataFrame([("position", "a"), ("position", "a"), ("fen", "b")], "kind string, key string")
    assert sorted(map(tuple, L.missing(path, work).collect())) == [("fen", "b"), ("position", "a")]
    L.merge(path, evals(spark, [("a", "x", 1)]))
    assert [tuple(r) for r in L.missing(path, work).collect()] == [("fen", "b")]


def test_the_anti_join_reads_touched_parts_only(spark, tmp_dir):
    path = L.ledger_path(tmp_dir)
    L.merge(path, evals(spark, [(f"k{i}", None, i) for i in range(300)]), buckets=32)
    out = L.missing(path, spark.createDataFrame([("position", "k5"), ("position", "new")], "kind string, key string"), buckets=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan
    assert [r["key"] for r in out.collect()] == ["new"]
    assert spark.read.parquet(path).filter(F.col("bucket") == 0).columns  # a plain partitioned table
