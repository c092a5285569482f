"""Inputs the derived tables do not hold, with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from helpers import EVAL_ROWS, EVAL_SCHEMA, evals_df, prompts_df, rollouts_df
from rollout_tables.fixed_values import SPLITS_4WAY
from rollout_tables.operators.messages import with_prompt_inputs
from rollout_tables.operators.parse import parse_completions
from rollout_tables.operators.reports import group_advantage, group_stats
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.operators.splits import assign_splits, split_4way
from rollout_tables.sources.datasets import rl_train_split, sft_train_split, val_split


def by_id(df):
    return {r.rollout_id: r for r in df.collect()}


def test_rollouts_without_a_prompt_stay_with_reward_zero(spark):
    prompts = prompts_df(spark, [(1, "FIND_LAST_MOVE", [])])
    rollouts = rollouts_df(spark, [("a", 1, '{"move": "e2e4"}'), ("b", 99, '{"move": "e2e4"}'), ("c", None, "x"), ("d", None, "y")])
    scored = score_rollouts(rollouts, prompts, evals_df(spark))
    got = by_id(scored)
    assert {k: (r.category, r.reward) for k, r in got.items()} == {"a": ("FIND_LAST_MOVE", 1.0), "b": ("", 0.0), "c": ("", 0.0), "d": ("", 0.0)}
    assert by_id(group_advantage(scored))["c"].group_size == 2
    assert group_advantage(scored, stats=group_stats(scored)).count() == 4


def test_move_orders_that_share_a_position_count_once(spark):
    fen = EVAL_ROWS[1][1]
    rows = [*EVAL_ROWS, *((k, fen, "cp", 260, None, None) for k in ("x1", "x2"))]
    evals = spark.createDataFrame(rows, EVAL_SCHEMA)
    prompts = prompts_df(spark, [(1, "SORT_FENS", [])])
    answer = json.dumps({"sorted FENs": [EVAL_ROWS[0][1], fen]})
    assert by_id(score_rollouts(rollouts_df(spark, [("a", 1, answer)]), prompts, evals))["a"].reward_raw == 1.0


def test_side_to_move_without_a_fen_follows_the_move_count(spark):
    prompts = prompts_df(spark, [(1, "FIND_NEXT_BEST_MOVE", [])])
    rollouts = rollouts_df(spark, [("a", 1, '{"move": "e2e4"}')])
    want = by_id(score_rollouts(rollouts, prompts, evals_df(spark)))["a"].reward_raw
    bare = spark.createDataFrame([(k, None if k else f, *rest) for k, f, *rest in EVAL_ROWS], EVAL_SCHEMA)
    assert want < 0 and by_id(score_rollouts(rollouts, prompts, bare))["a"].reward_raw == want


@pytest.mark.parametrize("text,moves,fens", [
    ('{"moves": ["e2e4"], "FEN": "x"}', ["e2e4"], ["x"]),
    ("{'moves': ['e2e4'], 'FEN': 'x'}", ["top"], ["topfen"]),
    ('{"moves": ["e2e4"]} trailing', ["top"], ["topfen"]),
    ('{"moves": ["e2e4"]}{"moves": ["d2d4"]}', ["top"], ["topfen"]),
    (' {"moves": ["e2e4"], "FEN": null}\n', ["e2e4"], [None]),
    ("not json", ["top"], ["topfen"]),
    ("{}", [], []),
])
def test_prompt_inputs(spark, text, moves, fens):
    row = with_prompt_inputs(spark.createDataFrame([(text, ["top"], ["topfen"])], "input string, moves array<string>, FENs array<string>")).head()
    assert (row.moves, row.fens) == (moves, fens)


@pytest.mark.parametrize("text,state", [
    ('"e2e4" or "d2d4"', "text"), ("[1] or [2]", "text"), ("''1-0''", "text"), ('"1-0"', "non_object"), ("[1, 2]", "non_object"),
    ("NaN", "non_object"), ("-Infinity", "non_object"), ("null", "non_object"), ("12.5", "non_object"), ('{"a": 1}', "object"), ("", "text"),
])
def test_parse_states(spark, text, state):
    assert parse_completions(rollouts_df(spark, [("a", 1, text)])).head().json_state == state


def test_a_list_with_a_null_cannot_be_read(spark):
    rows = rollouts_df(spark, [("a", 1, '{"missing moves": ["e2e4", null]}'), ("b", 1, '{"missing moves": ["e2e4"]}')])
    scored = by_id(score_rollouts(rows, prompts_df(spark, [(1, "MLM_ON_MOVES", [])]), evals_df(spark)))
    assert scored["a"].reward_raw == -1.0 and scored["b"].reward_raw == 1.0


def test_splits_without_ranks_shuffle_no_other_column(spark):
    df = spark.range(5000).withColumn("wide", F.concat(F.lit("w"), F.col("id")))
    narrow = assign_splits(df, "id", SPLITS_4WAY, with_rank=False)
    want = {r.id: r.split for r in split_4way(df, "id").collect()}
    assert {r.id: r.split for r in narrow.collect()} == want
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("Sort", "Window", "Join", "Repartition", "Aggregate"))
    with pytest.raises(ValueError):
        assign_splits(df, "id", bucket_chars=6)


def test_many_split_names_are_no_error(spark):
    df = spark.range(3000).selectExpr("id", "concat('s', id) as split")
    assert sft_train_split(df, "s7").count() == 1 and rl_train_split(df.union(spark.sql("select -1L, 'train'")), "zz")[0].count() == 1
    assert val_split(df, "zz", ("s8",)).count() == 1 and val_split(df, "zz") is None
    with pytest.raises(ValueError):
        rl_train_split(df, "zz")


def test_repeated_rows_stay_and_mates_can_be_scaled(spark):
    prompts = prompts_df(spark, [(1, "SORT_FENS", []), (2, "FIND_NEXT_BEST_MOVE", []), (3, "FIND_NEXT_BEST_MOVE", ["e2e4"])])
    answer = json.dumps({"sorted FENs": [EVAL_ROWS[2][1], EVAL_ROWS[1][1], "unknown"]})
    rollouts = rollouts_df(spark, [("a", 1, answer)] * 3 + [("b", 2, '{"move": "e2e4"}')] * 2 + [("c", 3, '{"move": "e7e5"}')])
    scored = score_rollouts(rollouts, prompts, evals_df(spark)).collect()
    assert sorted(r.rollout_id for r in scored) == ["a", "a", "a", "b", "b", "c"]
    assert {r.reward_raw for r in scored if r.rollout_id == "a"} == {0.5 + 0.5 * 2 / 3}
    mates = spark.createDataFrame([(k, f, "mate" if k else t, 3 if k else v, *rest) for k, f, t, v, *rest in EVAL_ROWS], EVAL_SCHEMA)
    plain = by_id(score_rollouts(rollouts, prompts, mates))
    scaled = by_id(score_rollouts(rollouts, prompts, mates, mate="scaled"))
    assert abs(plain["c"].reward_raw) < 0.1 and scaled["c"].reward_raw > 0.99 and scaled["b"].reward_raw < -0.99
