"""What passes a join or a shuffle stays narrow, and generated code is compiled."""

import re

from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.functions.text import py_strip
from rollout_tables.operators.evals import position_children, resolve_positions, with_children
from rollout_tables.operators.messages import rl_prompts
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.plans import inputs as I
from rollout_tables.session import materialise

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_a_plain_session_gets_the_method_limit(spark):
    spark.conf.set(LIMIT, "65535")
    materialise(spark.range(3))
    assert spark.conf.get(LIMIT) == "8000"


def test_successors_are_met_behind_the_prompt(spark):
    evals, prompts = evals_df(spark), prompts_df(spark, [(1, "FIND_NEXT_BEST_MOVE", ["e2e4"]), (2, "MLM_ON_MOVES", ["e2e4"])])
    rollouts = rollouts_df(spark, [("a", 1, '{"move": "e7e5"}')])
    children = materialise(position_children(evals))
    plan = score_rollouts(rollouts, prompts, evals, categories=["FIND_NEXT_BEST_MOVE"], children=children)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # the topmost join is the one to the successors
    first = next(line for line in text.splitlines() if re.search(r"\bJoin\b", line))
    assert "parent_key" in first


def test_only_the_played_successor_is_kept(spark):
    evals = evals_df(spark)
    rows = resolve_positions(prompts_df(spark, [(1, "x", ["e2e4"]), (2, "x", []), (3, "x", ["e2e4"])]), evals)
    rows = rows.withColumn("m", F.get(F.array(F.lit("c7c5"), F.lit("e2e4"), F.lit("a7a6")), (F.col("record_id") - 1).cast("int")))
    out = with_children(rows, position_children(evals), F.lit(True), "record_id", F.col("m"))
    found = {r.record_id: r.child_cps for r in out.collect()}
    assert found[1] == [40] and found[2] == [250] and not found[3]


def test_strip_takes_what_the_unicode_pattern_takes(spark):
    texts = [f"{chr(c)}a{chr(c)}b{chr(c)}{chr(c)}" for c in range(1, 0x3100)] + ["", " \n ", "a \r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(py_strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


def test_derived_inputs_shuffle_source_rows(spark, tmp_dir):
    spark.createDataFrame([(k, k, "1-URGENT") for k in range(50)], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_dir}/orders.parquet")
    records, prompts = I.records(spark, tmp_dir), I.prompts(spark, tmp_dir)
    assert records.count() == prompts.count() == 50 and len(records.inputFiles()) > 1
    seen = {r.record_id: r for r in rl_prompts(records).collect()}
    assert all(seen[r.record_id] == r for r in prompts.collect())
