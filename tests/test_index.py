"""The stored evaluation index: same results, and lookups that leave the
evaluations where they are."""

import pytest
from pyspark.sql import functions as F

from helpers import EVAL_ROWS, evals_df, prompts_df, rollouts_df
from rollout_tables.operators.evals import resolve_positions
from rollout_tables.operators.index import _name, open_index, write_index
from rollout_tables.operators.rewards import score_rollouts

PROMPTS = [(1, "FIND_NEXT_BEST_MOVE", ["e2e4"]), (2, "SORT_FENS", []), (3, "FIND_LAST_MOVE", ["zz"]), (4, "FIND_NEXT_BEST_MOVE", []),
           (5, None, None), (6, "FIND_LAST_MOVE", ["e2e4", "e7e5"])]
ROLLOUTS = [("a", 1, '{"move": "e7e5"}'), ("b", 2, '{"sorted FENs": ["e2e4 b - 0", "unknown", "e2e4 c7c5 w - 0"]}'), ("c", 3, "e2e4"),
            ("d", 4, "e2e4"), ("e", 5, "x"), ("f", 6, '{"move": "g1f3"}'), ("f", 6, '{"move": "g1f3"}'), ("g", None, "")]


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rewards(spark, evals, **kw):
    out = score_rollouts(rollouts_df(spark, ROLLOUTS), prompts_df(spark, PROMPTS), evals, **kw)
    return sorted((r["rollout_id"], r["reward"]) for r in out.collect())


@pytest.mark.parametrize("mate", ["as_cp", "scaled"])
def test_same_rewards_from_the_index(spark, tmp_dir, mate):
    rows = [(k, f, "mate" if k == "e2e4 e7e5" else t, 3 if k == "e2e4 e7e5" else v, *rest) for k, f, t, v, *rest in EVAL_ROWS]
    evals = spark.createDataFrame(rows, evals_df(spark).schema)
    write_index(evals, f"{tmp_dir}/ix", mate, buckets=3)
    ix = open_index(spark, f"{tmp_dir}/ix")
    assert rewards(spark, ix.evals, children=ix.children, fens=ix.fens) == rewards(spark, evals, mate=mate)


def test_index_opens_in_a_session_that_did_not_write_it(spark, tmp_dir):
    path = f"{tmp_dir}/ix"
    write_index(evals_df(spark), path, buckets=4)
    before = sorted(map(str, open_index(spark, path).evals.collect()))
    for part in ("positions", "children", "fens"):
        spark.sql(f"DROP TABLE {_name(path, part)}")
    ix = open_index(spark, path)
    assert sorted(map(str, ix.evals.collect())) == before and len(before) == len(EVAL_ROWS)
    assert ix.evals.filter(F.col("position_key") == "e2e4").count() == 1
    with pytest.raises(Exception):
        write_index(evals_df(spark), path)


def _sides(plan):
    """Indented plan lines below each join, one list a side."""
    lines = plan.splitlines()

    def depth(x):
        return len(x) - len(x.lstrip(" :+-"))

    for i, line in enumerate(lines):
        if "SortMergeJoin" in line or "ShuffledHashJoin" in line:
            below = []
            for x in lines[i + 1:]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            cut = [k for k, x in enumerate(below) if depth(x) == min(map(depth, below))]
            yield [below[a:b] for a, b in zip(cut, [*cut[1:], None])]


def test_lookups_shuffle_no_evaluations(spark, tmp_dir, no_broadcast):
    write_index(evals_df(spark), f"{tmp_dir}/ix", buckets=4)
    ix = open_index(spark, f"{tmp_dir}/ix")
    from rollout_tables.operators.evals import with_children
    from rollout_tables.operators.rewards import sort_fen_counts
    prompts = prompts_df(spark, PROMPTS)
    lists = spark.createDataFrame([(1, ["e2e4 b - 0", "x"])], "_row long, pred_fens array<string>").withColumn("n_fens", F.size("pred_fens"))
    resolved = resolve_positions(prompts, ix.evals)
    for df, key in ((resolved, "position_key"), (with_children(resolved, ix.children, F.lit(True), "record_id"), "parent_key"), (sort_fen_counts(lists, ix.fens, "_row"), "fen_key")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sides = [s for pair in _sides(plan) for s in pair if any(key in x and "Bucketed: true" in x for x in s) and not any("Join" in x for x in s)]
        assert sides, plan
        assert not any("Exchange" in x or "Sort " in x for x in sides[0] if "Sort [" not in x), plan
    # the start position never enters the join
    assert "EqualTo(position_key,)" in resolved._jdf.queryExecution().executedPlan().toString() or "Subquery" in resolved._jdf.queryExecution().executedPlan().toString()
