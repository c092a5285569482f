"""I1-I6, A7."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollout_tables.operators.reports import (
    completion_lengths, completion_sample, exact_quantiles, group_advantage, reward_by_category, reward_by_interval,
    reward_slope, reward_trend,
)

SCORED = "rollout_id string, prompt_id long, step long, category string, json_state string, reward_raw double, " \
         "penalty double, reward double"


def _scored(spark, rows):
    return spark.createDataFrame([(r, p, s, c, "object", x, 0.0, x) for r, p, s, c, x in rows], SCORED)


def test_group_advantage(spark):
    rows = [("a", 1, 0, "K", 1.0), ("b", 1, 0, "K", 0.0), ("c", 1, 0, "K", 0.5), ("d", 2, 0, "K", 0.3)]
    got = {r["rollout_id"]: r for r in group_advantage(_scored(spark, rows)).collect()}
    std = float(np.std([1.0, 0.0, 0.5], ddof=1))
    assert got["a"]["advantage"] == pytest.approx(0.5 / (std + 1e-4))
    assert sum(got[k]["advantage"] for k in "abc") == pytest.approx(0.0, abs=1e-9)
    assert got["d"]["advantage"] == 0.0 and got["d"]["group_size"] == 1


def test_interval_and_trend(spark):
    rows = [(str(i), i, i, "K", float(i // 100)) for i in range(300)]
    by = {r["interval_start"]: r for r in reward_by_interval(_scored(spark, rows)).collect()}
    assert len(by) == 30 and by[120]["reward"] == 1.0 and by[120]["n"] == 10
    tr = {r["interval_start"]: r for r in reward_trend(_scored(spark, rows), interval_steps=100).collect()}
    assert tr[0]["gain_per_1000_steps"] is None
    assert tr[100]["gain_per_1000_steps"] == pytest.approx(10.0) and tr[200]["meets_target"]


def test_category_rollup(spark):
    rows = [("a", 1, 0, "A", 1.0), ("b", 1, 0, "A", 0.0), ("c", 2, 0, "B", -1.0)]
    got = {r["category"]: r for r in reward_by_category(_scored(spark, rows)).collect()}
    assert got["A"]["n"] == 2 and got["A"]["mean_reward"] == 0.5
    assert got[None]["n"] == 3 and got[None]["mean_reward"] == pytest.approx(0.0)


def test_exact_quantiles_nearest_rank(spark):
    vals = [5, 1, 9, 9, 3, 7, 2, 8, 8, 8, 4]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    got = exact_quantiles(df, "x", [0.5, 0.9]).collect()[0]
    s = sorted(vals)
    assert got["p50"] == s[math.ceil(0.5 * len(s)) - 1] and got["p90"] == s[math.ceil(0.9 * len(s)) - 1]


def test_completion_lengths_and_sample(spark):
    df = spark.createDataFrame([("a", 1, 0, "x" * 100), ("b", 1, 0, "y" * 400), ("c", 2, 1, "z" * 1200),
                                ("d", 2, 2, "short")], "rollout_id string, prompt_id long, step long, completion string")
    L = completion_lengths(df).collect()[0]
    assert (L["n"], L["min_tokens"], L["max_tokens"], L["n_in_target"], L["n_at_cap"]) == (4, 1.25, 300.0, 1, 1)
    sample = {r["step"]: r for r in completion_sample(df).collect()}
    assert set(sample) == {1} and sample[1]["sample"] == "z" * 200
    assert completion_sample(df.filter(F.col("rollout_id") != "a")).filter("step = 0").collect()[0]["sample"] == "y" * 200


def test_trend_over_gaps_uses_true_distances(spark):
    rows = [("a", 1, 100, "K", 0.1), ("b", 1, 900, "K", 0.2), ("c", 2, 1000, "L", 0.2), ("d", 2, None, "L", 9.0)]
    got = {r["interval_start"]: r for r in reward_trend(_scored(spark, rows)).collect()}
    assert got[900]["gain_per_1000_steps"] == pytest.approx(0.125) and got[900]["meets_target"]
    assert got[1000]["gain_per_1000_steps"] == pytest.approx(0.0) and not got[1000]["meets_target"]
    whole = reward_trend(_scored(spark, rows), complete=True).orderBy("interval_start").collect()
    assert [r["interval_start"] for r in whole] == list(range(100, 1001, 100))
    assert [r["interval_start"] for r in whole if r["mean_reward"] is not None] == [100, 900, 1000]
    per = {r["interval_start"]: r for r in reward_by_interval(_scored(spark, rows), 100, complete=True).collect()}
    assert len(per) == 10 and per[500]["n"] == 0 and per[500]["reward"] is None and per[900]["n"] == 1
    assert reward_trend(_scored(spark, []), complete=True).count() == 0


def test_slope_is_least_squares_over_rollouts(spark):
    rng = np.random.default_rng(1)
    steps = rng.choice([0, 5, 40, 2000, 2010], 60)
    rewards = 0.3 * steps / 1000 + rng.normal(0, 0.05, 60)
    rows = [(str(i), i, int(s), "AB"[i % 2], float(r)) for i, (s, r) in enumerate(zip(steps, rewards))] + [("x", 0, None, "A", 5.0), ("y", 0, 7, "C", 1.0)]
    got = {r["category"]: r for r in reward_slope(_scored(spark, rows)).collect()}
    for name, at in (("A", slice(0, 60, 2)), ("B", slice(1, 60, 2))):
        assert got[name]["slope_per_1000_steps"] == pytest.approx(1000 * np.polyfit(steps[at], rewards[at], 1)[0])
    assert got["A"]["meets_target"] and got["C"]["slope_per_1000_steps"] is None and got[None]["n"] == 61
