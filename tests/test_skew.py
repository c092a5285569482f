"""A hot prompt (a third of all rollouts) and a hot position: same results,
and AQE splits the skewed join partitions instead of one task taking them."""

import pytest
from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.operators.reports import group_advantage, group_stats
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.session import materialise

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1024",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_prompt_and_position(spark, skew_conf):
    prompts = prompts_df(spark, [(p, "FIND_LAST_MOVE", ["e2e4"] if p % 10 else ["e2e4", "e7e5"])
                                 for p in range(1, 201)])
    rows = [(f"h{i}", 1, '{"move": "e7e5"}') for i in range(1500)]
    rows += [(f"r{i}", 2 + i % 199, '{"move": "c7c5"}' if i % 2 else '{"move": "e7e5"}') for i in range(3000)]
    ro = rollouts_df(spark, rows).repartition(8)
    scored = score_rollouts(ro, prompts, evals_df(spark))
    adv = group_advantage(scored)
    got = adv.collect()
    assert len(got) == 4500
    by_id = {r["rollout_id"]: r for r in got}
    assert all(by_id[f"h{i}"]["reward"] == 1.0 and by_id[f"h{i}"]["advantage"] == 0.0 for i in range(1500))
    assert by_id["h0"]["group_size"] == 1500
    # prompts 10, 20, ... sit on the position after e2e4 e7e5 (best g1f3): e7e5 is no candidate there
    r = [x for x in got if x["prompt_id"] == 10][0]
    assert r["reward"] in (-0.25,)
    plan = adv._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    assert "SortMergeJoin(skew=true)" in plan  # the hot prompt partition was split
    assert adv.filter(F.col("prompt_id") == 1).count() == 1500


def test_hot_group_is_split_in_the_join_to_its_statistics(spark, skew_conf):
    """I1 as the report job runs it: the only join of the plan is that to the
    written statistics."""
    rows = spark.range(6000).select(F.concat(F.lit("r"), F.col("id")).alias("rollout_id"),
                                    F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("prompt_id"),
                                    (F.col("id") % 7 / 7).alias("reward"))
    scored = materialise(rows.repartition(8), "skew-scored")
    out = group_advantage(scored, stats=materialise(group_stats(scored), "skew-stats"))
    got = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(got) == 6000 and sum(r["group_size"] == 2001 for r in got) == 2001
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin(skew=true)" in plan
