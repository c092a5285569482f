"""The command-line jobs end to end on a small derived record table."""

from pyspark.sql import functions as F

from conftest import SF001
from rollout_tables import jobs
from rollout_tables.sources import fixtures as fx


def test_split_prep_score_report(spark, tmp_dir):
    fx.records(spark, SF001).write.parquet(f"{tmp_dir}/records")
    jobs.main(["split", "--input", f"{tmp_dir}/records", "--output", f"{tmp_dir}/splits", "--with-validation"])
    parts = {r["split"]: r["n"] for r in spark.read.parquet(f"{tmp_dir}/splits_report").collect()}
    assert parts == {"sft_train": 960, "sft_val": 90, "rl": 300, "test": 150}
    jobs.main(["prep-sft", "--input", f"{tmp_dir}/splits", "--split", "sft_train", "--output", f"{tmp_dir}/sft"])
    assert spark.read.parquet(f"{tmp_dir}/sft").count() == 960
    jobs.main(["prep-rl", "--input", f"{tmp_dir}/splits", "--split", "rl", "--output", f"{tmp_dir}/prompts"])
    prompts = spark.read.parquet(f"{tmp_dir}/prompts")
    assert prompts.count() == 300
    fx.rollouts(spark, SF001).write.parquet(f"{tmp_dir}/rollouts")
    fx.evals(spark, SF001, prompts).write.parquet(f"{tmp_dir}/evals")
    jobs.main(["score", "--rollouts", f"{tmp_dir}/rollouts", "--prompts", f"{tmp_dir}/prompts",
               "--evals", f"{tmp_dir}/evals", "--output", f"{tmp_dir}/rewards"])
    rewards = spark.read.parquet(f"{tmp_dir}/rewards")
    rl_ids = {r["record_id"] for r in prompts.select("record_id").collect()}
    assert rewards.count() == fx.rollouts(spark, SF001).count()
    assert rewards.filter(~F.col("prompt_id").isin(list(rl_ids)) & (F.col("reward_raw") != 0)).count() == 0
    jobs.main(["report", "--rewards", f"{tmp_dir}/rewards", "--output", f"{tmp_dir}/reports"])
    assert spark.read.parquet(f"{tmp_dir}/reports/by_category").count() >= 2
    rows = {r["rollout_id"]: r["reward"] for r in rewards.collect()}
    jobs.main(["index", "--evals", f"{tmp_dir}/evals", "--output", f"{tmp_dir}/index", "--buckets", "3"])
    jobs.main(["score", "--rollouts", f"{tmp_dir}/rollouts", "--prompts", f"{tmp_dir}/prompts",
               "--index", f"{tmp_dir}/index", "--output", f"{tmp_dir}/indexed"])
    assert {r["rollout_id"]: r["reward"] for r in spark.read.parquet(f"{tmp_dir}/indexed").collect()} == rows
    jobs.main(["worklist", "--rollouts", f"{tmp_dir}/rollouts", "--prompts", f"{tmp_dir}/prompts",
               "--evals", f"{tmp_dir}/evals", "--output", f"{tmp_dir}/work"])
    assert set(spark.read.parquet(f"{tmp_dir}/work").columns) == {"kind", "key"}
    jobs.main(["completions", "--rollouts", f"{tmp_dir}/rollouts", "--output", f"{tmp_dir}/reports"])
    assert spark.read.parquet(f"{tmp_dir}/reports/lengths").first()["n"] == len(rows)
    jobs.main(["parse", "--rollouts", f"{tmp_dir}/rollouts", "--output", f"{tmp_dir}/answers"])
    jobs.main(["score", "--rollouts", f"{tmp_dir}/answers", "--prompts", f"{tmp_dir}/prompts",
               "--evals", f"{tmp_dir}/evals", "--output", f"{tmp_dir}/again"])
    assert {r["rollout_id"]: r["reward"] for r in spark.read.parquet(f"{tmp_dir}/again").collect()} == rows
    fx.token_rows(spark, SF001).write.parquet(f"{tmp_dir}/tokens")
    jobs.main(["tokens", "--input", f"{tmp_dir}/tokens", "--output", f"{tmp_dir}/masked", "--max-len", "64", "--pad-id", "0"])
    assert {r["n"] for r in spark.read.parquet(f"{tmp_dir}/masked").selectExpr("size(labels) AS n").collect()} == {64}
    assert spark.read.parquet(f"{tmp_dir}/masked_audit").first()["n_rows"] == spark.read.parquet(f"{tmp_dir}/tokens").count()
