"""Stored answers: the labels of the parse, read from pushed fields."""

import pytest
from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.operators.objects import read_labels, stored_answers
from rollout_tables.operators.parse import PARSED_COLUMNS, parse_completions
from rollout_tables.operators.rewards import score_rollouts
from test_completions import CASES, LISTS, THINK

MORE = ['{"move": 1.50, "Move": 2, "score": 1e400}', '{"score": {"b": 1, "a": [1, null]}}', '{"move": [1, "a", null], "score": null}', "{}",
        '{"missing moves": [null, "a"], "sorted fens": [1, null, {"x": 2}]}', '{"score": false, "score": 10000000000000000000000}', None, '{"": 1, "x": 2}',
        THINK + 'abcd {"move": "a1a1"}\n</think> {"move": "e2e4", "extra": {"depth": 3}}', '{"Depth": 6, "depth": 7, "depth": 8, "score": "1-0"}']
TEXTS = [c for c, *_ in CASES] + [c for c, *_ in LISTS] + MORE


@pytest.fixture(scope="module")
def rollouts(spark):
    return rollouts_df(spark, [(str(i), i % 4, c) for i, c in enumerate(TEXTS)]).withColumn("answer", F.lit("clash"))


def written(df, tmp_dir):
    df.write.mode("overwrite").parquet(f"{tmp_dir}/answers")
    return df.sparkSession.read.parquet(f"{tmp_dir}/answers")


def rows(df, columns=("rollout_id", *PARSED_COLUMNS)):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("strip", [False, True])
def test_labels_equal_the_parse(rollouts, tmp_dir, strip):
    stored = written(stored_answers(rollouts, strip_think=strip), tmp_dir)
    assert rows(read_labels(stored)) == rows(parse_completions(rollouts, strip_think=strip))


def test_only_wanted_fields_are_read_and_nothing_is_parsed(rollouts, tmp_dir):
    stored = written(stored_answers(rollouts), tmp_dir)
    labels = read_labels(stored, ["FIND_FINAL_SCORE"]).select("rollout_id", "pred_score")
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "answer:struct<0:variant>" in plan
    for word in ("from_json", "from_variant", "regexp_extract", "other", "text_move"):
        assert word not in plan.split("ReadSchema")[1]
    assert "from_json" not in plan and "regexp_extract(" not in plan
    assert rows(labels, ["rollout_id", "pred_score"]) == rows(parse_completions(rollouts), ["rollout_id", "pred_score"])
    assert all(r.pred_move is None and r.pred_fens is None for r in read_labels(stored, ["FIND_FINAL_SCORE"]).collect())


def test_entries_of_no_rule_are_kept(rollouts, tmp_dir):
    stored = written(stored_answers(rollouts), tmp_dir)
    depth = stored.select("rollout_id", F.try_variant_get("other", "$.depth", "int").alias("d")).filter("d is not null")
    at = len(TEXTS)
    assert {r.rollout_id: r.d for r in depth.collect()} == {str(at - 1): 8}
    assert stored.filter(F.try_variant_get("other", "$.score", "string").isNotNull()).count() == 0


def test_scores_of_stored_answers(spark, rollouts, tmp_dir):
    prompts = prompts_df(spark, [(0, "FIND_NEXT_BEST_MOVE", ["e2e4"]), (1, "SORT_FENS", []), (2, "FIND_LAST_MOVE", []), (3, "FIND_FINAL_SCORE", ["e2e4"])])
    stored = written(stored_answers(rollouts), tmp_dir)
    for kw in ({}, {"categories": ["SORT_FENS", "FIND_FINAL_SCORE"]}, {"extra_rules": {"OWN": F.lit(0.5)}}):
        direct, again = (score_rollouts(x, prompts, evals_df(spark), **kw) for x in (rollouts, stored))
        assert rows(direct, direct.columns) == rows(again, direct.columns)


def test_empty_table(spark, tmp_dir):
    stored = written(stored_answers(rollouts_df(spark, [("a", 1, "x")]).limit(0)), tmp_dir)
    assert read_labels(stored).collect() == []
