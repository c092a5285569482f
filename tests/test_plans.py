"""Driver contract and plan shape."""

import re

from __spark_entry__ import entry, oracle_sql, queries
from conftest import SF001
from rollout_tables.operators import evals as EV
from rollout_tables.operators import rewards as G
from rollout_tables.plans import inputs as I
from rollout_tables.plans.queries import QUERIES


def test_contract_keys():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert {k for k in set(q) - set(o) if k in QUERIES} == set()


def test_entry_runs(spark):
    df = entry(spark)
    rows = df.collect()
    assert {"category", "n", "mean_reward"} <= set(df.columns)
    total = [r for r in rows if r["category"] is None][0]
    assert total["n"] == 6000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_hot_paths(spark):
    for name in ("reward_all", "completion_parse", "rl_prompts", "token_rows_masked", "split_4way_assign"):
        plan = _plan(QUERIES[name](spark, SF001))
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name


def test_scans_are_pruned(spark):
    plan = QUERIES["completion_lengths"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<completion:string>" in plan or "struct<completion:string>" in plan
    I.prepare(spark, SF001)


def test_rewards_scan_rollouts_once_and_shuffle_no_completion(spark):
    prompts, evals, rollouts = (f(spark, SF001) for f in (I.prompts, I.evals, I.rollouts))
    labelled = G.label_rollouts(rollouts, EV.resolve_positions(prompts, evals)).drop("prompt")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in (("labels", labelled), ("positions_to_evaluate", QUERIES["positions_to_evaluate"](spark, SF001))):
            plan = _plan(df)
            lines = plan.splitlines()
            scans = [i for i, x in enumerate(lines) if "FileScan" in x and "completion" in x]
            assert len(scans) == 1, name

            def depth(x):
                return len(x) - len(x.lstrip(" :+-"))

            exchange = max(i for i in range(scans[0]) if "Exchange" in lines[i] and depth(lines[i]) < depth(lines[scans[0]]))
            project = next(x for x in lines[exchange + 1:] if "Project [" in x)
            names = [re.sub(r".* AS ", "", x) for x in re.split(r", (?![^(]*\))", project.split("Project [", 1)[1].rstrip("]"))]
            assert any(x.startswith("pred_") for x in names), name
            assert not any(x.startswith(("completion#", "_c#")) for x in names), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_only_usable_fen_lists_pass_the_fen_lookup(spark):
    """The written labels are read twice: rows with a FEN list for the lookup
    and the fold, all others as they are. No completion, no window."""
    df = QUERIES["reward_all"](spark, SF001)
    plan = _plan(df)
    assert "completion" not in plan and "Window" not in plan and "Union" in plan
    reads = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    assert any("IsNull(pred_fens)" in r for r in reads) and any("IsNotNull(pred_fens)" in r for r in reads)
    assert "Exchange" not in plan.split("Union")[1].split("FileScan")[0]


def test_category_key_is_searched_once(spark):
    """Behind the prompt join a row reads one value, whatever its category."""
    prompts, evals, rollouts = (f(spark, SF001) for f in (I.prompts, I.evals, I.rollouts))
    labelled = G.label_rollouts(rollouts, EV.resolve_positions(prompts, evals))
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS _v#") == 1 and plan.count("AS _s#") == 1


def test_tables_of_the_reward_job_are_written_small(spark):
    """the derived inputs and the labelled rows are zstd files."""
    for df in (I.rollouts(spark, SF001), I.prompts(spark, SF001), QUERIES["reward_all"](spark, SF001)):
        assert all(f.endswith(".zstd.parquet") for f in df.inputFiles())
