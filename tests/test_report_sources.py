"""Counts from footers, split names from folders, sketches, SQL functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.functions.sql import register
from rollout_tables.operators import sketches as SK
from rollout_tables.operators.evals import resolve_positions
from rollout_tables.operators.parse import parse_completions
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.sources import datasets as DS
from rollout_tables.sources.footers import footer_counts


@pytest.fixture
def splits(spark, tmp_dir):
    path = f"{tmp_dir}/s p"
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, "train").when(F.col("id") < 900, "va l=1").otherwise(F.lit(None)).alias("split"))
    DS.write_splits(df, path)
    return path


def test_counts_come_from_the_footers(spark, splits):
    df = footer_counts(spark, splits, ["split"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "PushedGroupBy: [split]" in plan
    assert {r["split"]: r["n"] for r in df.collect()} == {"train": 700, "va l=1": 200, None: 100}
    assert footer_counts(spark, splits).first()["n"] == 1000
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_split_names_without_a_job(spark, splits):
    sc = spark.sparkContext
    df = spark.read.parquet(splits)
    sc.setJobGroup("names", "split names")
    known = DS.split_names(df)
    train = DS.sft_train_split(df, "train", known=known)
    rl, has_eval = DS.rl_train_split(df, "absent", known=known)
    val = DS.val_split(df, "absent", ("va l=1",), known=known)
    with pytest.raises(ValueError):
        DS.sft_train_split(df, "absent", known=known)
    assert list(sc.statusTracker().getJobIdsForGroup("names")) == []
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert known == {"train", "va l=1"} and has_eval
    assert (train.count(), rl.count(), val.count()) == (700, 700, 200)


def test_tables_without_split_folders_have_no_names(spark, tmp_dir):
    spark.range(3).withColumn("split", F.lit("x")).write.parquet(f"{tmp_dir}/t")
    assert DS.split_names(spark.read.parquet(f"{tmp_dir}/t")) is None
    assert DS.split_names(spark.range(3)) is None


def test_merged_sketches_keep_the_rank_bound(spark):
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(0, 3000, 20000), np.full(10000, 41), rng.geometric(0.01, 9000)])
    df = spark.createDataFrame([(int(i % 97), "ab"[i % 2], "x" * int(n)) for i, n in enumerate(lengths[:4000])] + [(5, "c", None)], "step long, category string, completion string")
    for k in (64, 800):
        steps = SK.length_sketches(df, ["step", "category"], k)
        for by in (["category"], []):
            got = SK.sketch_quantiles(SK.merged_sketches(steps, by), [0.05, 0.5, 0.95]).collect()
            assert len(got) == (9 if by else 3)
            for r in got:
                own = sorted(len(x["completion"] or "") for x in df.collect() if not by or x["category"] == r["category"])
                below, upto = np.searchsorted(own, r["chars"], "left") / len(own), np.searchsorted(own, r["chars"], "right") / len(own)
                assert r["n"] == len(own) and r["tokens"] == r["chars"] / 4
                assert below - SK.rank_error(k) <= r["p"] <= upto + SK.rank_error(k)


def test_rules_in_sql_equal_the_rules(spark):
    assert "rule_final_score" in register(spark)
    prompts = prompts_df(spark, [(1, "FIND_ADVANTAGED_PLAYER", ["e2e4"]), (2, "FIND_FINAL_SCORE", ["e2e4", "e7e5"]), (3, "FIND_LAST_MOVE", ["e2e4"]), (4, "FIND_FINAL_SCORE", [])])
    texts = ['{"most advantaged": "White"}', "black", "[1]", '{"score": "0-1"}', " 1/2-1/2 ", '{"move": "e7e5"}', '{"move": ""}', "c7c5", "<|im_start|>assistant\n<think>\n" + "y" * 4000 + "\n</think> 1-0"]
    rollouts = rollouts_df(spark, [(f"r{i}{p}", p, t) for i, t in enumerate(texts) for p in (1, 2, 3, 4)])
    for credit in (True, False):
        want = {r["rollout_id"]: (r["reward_raw"], r["penalty"], r["think_tokens"]) for r in score_rollouts(rollouts, prompts, evals_df(spark), draw_partial_credit=credit).collect()}
        parse_completions(rollouts).createOrReplaceTempView("sql_parsed")
        rollouts.createOrReplaceTempView("sql_rollouts")
        resolve_positions(prompts, evals_df(spark)).createOrReplaceTempView("sql_prompts")
        got = spark.sql(f"""
            SELECT rollout_id, CASE category WHEN 'FIND_ADVANTAGED_PLAYER' THEN rule_advantaged_player(json_state, pred_advantage, eval_value, {credit})
                     WHEN 'FIND_FINAL_SCORE' THEN rule_final_score(json_state, pred_score, eval_value)
                     ELSE rule_last_move(json_state, pred_move, best_move, transform(top_moves, m -> m.move)) END AS raw,
                   reasoning_penalty(think_token_count(completion)) AS penalty, think_token_count(completion) AS tokens
            FROM sql_parsed JOIN sql_prompts ON prompt_id = record_id""")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Subquery" not in plan.split("Scan")[0]
        for r in got.collect():
            assert (r["raw"], r["penalty"], r["tokens"]) == pytest.approx(want[r["rollout_id"]])
    row = spark.sql("SELECT centipawns('mate', 3, true) AS a, centipawns('mate', 3, false) AS b, centipawns('cp', NULL, true) AS c, reward_linear(900, false) AS d, reward_scaled(-9000, true) AS e").first()
    assert (row["a"], row["b"], row["c"], row["d"]) == (10003, 3, 0, -1.0) and row["e"] == pytest.approx(-1.0)
