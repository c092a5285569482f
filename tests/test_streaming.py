"""The REWARD job as a stream over rollout files."""

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.streaming.rewards import stream_rewards


def test_stream_matches_batch(spark, tmp_dir):
    prompts = prompts_df(spark, [(1, "FIND_LAST_MOVE", ["e2e4"]), (2, "FIND_ADVANTAGED_PLAYER", [])])
    batches = [[("a", 1, '{"move": "e7e5"}'), ("b", 2, "white")], [("c", 1, '{"move": "c7c5"}')]]
    src, out = f"{tmp_dir}/in", f"{tmp_dir}/out"
    for i, rows in enumerate(batches):
        rollouts_df(spark, rows).write.mode("append").parquet(src)
    q = stream_rewards(spark, src, prompts, evals_df(spark), out, checkpoint_location=f"{tmp_dir}/ck")
    q.awaitTermination(120)
    streamed = {r["rollout_id"]: r["reward"] for r in spark.read.parquet(out).collect()}
    batch = {r["rollout_id"]: r["reward"] for r in
             score_rollouts(rollouts_df(spark, [x for b in batches for x in b]), prompts, evals_df(spark)).collect()}
    assert streamed == batch


def test_restart_processes_only_new_files(spark, tmp_dir):
    prompts = prompts_df(spark, [(1, "FIND_LAST_MOVE", ["e2e4"])])
    src, out, ck = f"{tmp_dir}/in", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    rollouts_df(spark, [("a", 1, '{"move": "e7e5"}')]).write.mode("append").parquet(src)
    stream_rewards(spark, src, prompts, evals_df(spark), out, checkpoint_location=ck).awaitTermination(120)
    rollouts_df(spark, [("b", 1, '{"move": "c7c5"}')]).write.mode("append").parquet(src)
    stream_rewards(spark, src, prompts, evals_df(spark), out, checkpoint_location=ck).awaitTermination(120)
    got = sorted((r["rollout_id"], r["reward"]) for r in spark.read.parquet(out).collect())
    assert got == [("a", 1.0), ("b", 0.5)]
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 2
