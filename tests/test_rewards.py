"""G1-G10 rule tables on a few positions with known evaluations."""

import math

import pytest
from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.operators.rewards import score_rollouts, weighted_rewards
from rollout_tables.sources.fixtures import weights

T = math.tanh
THINK = "<|im_start|>assistant\n<think>\n"

PROMPTS = [
    (1, "FIND_NEXT_BEST_MOVE", ["e2e4"]),
    (2, "FIND_NEXT_BEST_MOVE", ["zz"]),            # unknown position: start
    (3, "FIND_ADVANTAGED_PLAYER", ["e2e4"]),       # cp 250
    (4, "FIND_ADVANTAGED_PLAYER", []),             # cp 30
    (5, "FIND_FINAL_SCORE", ["e2e4"]),
    (6, "FIND_FINAL_SCORE", ["e2e4", "e7e5"]),     # cp -600
    (7, "MLM_ON_MOVES", ["e2e4"]),
    (8, "FIND_LAST_MOVE", ["e2e4"]),
    (9, "SORT_FENS", []),
    (10, "OTHER", ["e2e4"]),
    (11, None, ["e2e4"]),
]

CASES = [
    # rollout, prompt, completion, expected reward_raw
    ("n1", 1, '{"next best move": "e7e5"}', T(-600 / 200)),
    ("n2", 1, "I like c7c5", T(40 / 200)),
    ("n3", 1, '"1-0"', -0.1),
    ("n4", 1, '{"next best move": "a7a6"}', -0.1),
    ("n5", 2, '{"move": "e2e4"}', T(-250 / 200)),
    ("n6", 1, "", -0.1),
    ("a1", 3, '{"Most advantaged": "White"}', max(0.5, T(250 / 200))),
    ("a2", 3, '{"Most advantaged": "black"}', -0.5),
    ("a3", 3, "white is better", max(0.5, T(250 / 200))),
    ("a4", 3, "[1]", -1.0),
    ("a5", 3, '{"foo": 1}', -0.5),
    ("a6", 4, '{"most advantaged": "draw"}', max(0.0, T(30 / 200) * 0.3)),
    ("a7", 4, '{"most advantaged": "white"}', max(-0.5, -abs(T(30 / 200)))),
    ("s1", 5, '{"score": "1-0"}', max(0.3, 0.8 * T(250 / 200))),
    ("s2", 5, " 1-0 ", max(0.3, 0.8 * T(250 / 200))),
    ("s3", 5, '"1-0"', -1.0),
    ("s4", 5, '{"score": "1/2-1/2"}', -0.15),
    ("s5", 5, '{"score": "0-1"}', -0.5),
    ("s6", 6, '{"score": "0-1"}', 0.5),
    ("m1", 7, '{"missing moves": ["e7e5", "a7a6"]}', 0.75),
    ("m2", 7, '{"missing moves": "[e7e5, c7c5, ?]"}', 1.0),
    ("m3", 7, '{"missing moves": ["e7e5", "?"]}', 0.75),
    ("m4", 7, '{"missing moves": []}', -1.0),
    ("m5", 7, "e7e5", -1.0),
    ("m6", 7, '{"missing moves": 5}', -1.0),
    ("l1", 8, '{"missing move": "e7e5"}', 1.0),
    ("l2", 8, '{"move": "c7c5"}', 0.5),
    ("l3", 8, '{"move": "a7a6"}', -0.25),
    ("l4", 8, '{"move": ""}', -0.5),
    ("l5", 8, "no move here", -0.5),
    ("l6", 8, "[1]", -1.0),
    ("f1", 9, '{"sorted FENs": ["e2e4 e7e5 w - 0", "e2e4 c7c5 w - 0", "e2e4 b - 0"]}', 1.0),
    ("f2", 9, '{"sorted FENs": ["e2e4 b - 0", "unknown", "e2e4 c7c5 w - 0"]}', 0.5 + 0.5 / 3),
    ("f3", 9, '{"sorted FENs": "[e2e4 b - 0, e2e4 e7e5 w - 0]"}', 0.75),
    ("f4", 9, '{"sorted FENs": ["e2e4 b - 0"]}', -1.0),
    ("f5", 9, '{"sorted FENs": 3}', -1.0),
    ("f6", 9, "text", -1.0),
    ("o1", 10, '{"move": "e7e5"}', 0.0),
    ("o2", 11, '{"move": "e7e5"}', 0.0),
]


@pytest.fixture(scope="module")
def scored(spark):
    ro = rollouts_df(spark, [(i, p, c) for i, p, c, _ in CASES]
                     + [("t1", 8, THINK + "x" * 4000 + '\n</think>\n{"move": "e7e5"}')])
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark))
    return {r["rollout_id"]: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_rule_table(scored, case):
    rid, _, completion, expected = case
    assert scored[rid]["reward_raw"] == pytest.approx(expected, abs=1e-9), completion
    assert scored[rid]["penalty"] == 0.0


def test_every_rollout_scored_once(scored):
    assert len(scored) == len(CASES) + 1


def test_reasoning_penalty(scored):
    r = scored["t1"]
    assert r["think_tokens"] == 1000.0
    assert r["penalty"] == pytest.approx(0.1 * (1 - math.exp(-500 / 300)))
    assert r["reward"] == pytest.approx(1.0 - r["penalty"])


def test_draw_partial_credit(spark):
    ro = rollouts_df(spark, [("a7", 4, '{"most advantaged": "white"}')])
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark), draw_partial_credit=True)
    assert out.collect()[0]["reward_raw"] == pytest.approx(-0.2)


def test_linear_scaling(spark):
    ro = rollouts_df(spark, [("n2", 1, "I like c7c5")])
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark), scaling="linear")
    assert out.collect()[0]["reward_raw"] == pytest.approx(40 / 500)


def test_extra_rule(spark):
    ro = rollouts_df(spark, [("o1", 10, "anything")])
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark), extra_rules={"OTHER": F.lit(0.25)})
    assert out.collect()[0]["reward_raw"] == 0.25


def test_order_invariance(spark, scored):
    ro = rollouts_df(spark, [(i, p, c) for i, p, c, _ in reversed(CASES)]).repartition(7)
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark))
    for r in out.collect():
        assert r["reward_raw"] == pytest.approx(scored[r["rollout_id"]]["reward_raw"])


def test_rewards_bounded(scored):
    assert all(-1.0 <= r["reward_raw"] <= 1.0 for r in scored.values())


def test_weights(spark, scored):
    ro = rollouts_df(spark, [(i, p, c) for i, p, c, _ in CASES])
    w = weighted_rewards(score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark)), weights(spark))
    got = {r["category"]: r["weight"] for r in w.select("category", "weight").distinct().collect()}
    assert got["FIND_FINAL_SCORE"] == 0.8 and got["SORT_FENS"] == 0.5 and got["OTHER"] == 1.0


def test_category_subset(spark, scored):
    ro = rollouts_df(spark, [(i, p, c) for i, p, c, _ in CASES])
    out = score_rollouts(ro, prompts_df(spark, PROMPTS), evals_df(spark), categories=["SORT_FENS", "OTHER"])
    got = {r["rollout_id"]: r["reward_raw"] for r in out.collect()}
    assert set(got) == {i for i, *_ in CASES if i[0] in "fo" and i != "o2"}
    assert all(got[k] == pytest.approx(scored[k]["reward_raw"]) for k in got)
