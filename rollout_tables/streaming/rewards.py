"""Streaming reward scoring.

During training the reward callback receives one batch of completions at a
time. As a Structured Streaming query: rollout files land in a folder, each
micro-batch is scored against the (static) prompt and evaluation tables with
the same ``score_rollouts`` job, and written under ``batch_id=<n>``. Writing
each batch to its own folder with overwrite makes a replayed batch (after a
failure, from the checkpoint) replace its own output, so the sink is
idempotent. No state is kept across batches: every reward depends only on
its own rollout, as in the batch job. The lookup tables are derived and
written once, when the query starts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rollout_tables.operators.evals import fen_values, position_children, scored_evals
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.session import checkpoint_dir, materialise

ROLLOUT_SCHEMA = "rollout_id string, prompt_id bigint, step bigint, completion string"


def stream_rewards(spark: SparkSession, rollout_dir: str, prompts: DataFrame, evals: DataFrame, out_dir: str,
                   checkpoint_location: str | None = None, schema: str = ROLLOUT_SCHEMA,
                   max_files_per_trigger: int | None = None, available_now: bool = True,
                   **score_options) -> StreamingQuery:
    """Starts the streaming REWARD job and returns the running query."""
    if checkpoint_location is None:
        checkpoint_location = os.path.join(checkpoint_dir(spark), "streams", "rewards")
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    source = reader.parquet(rollout_dir)

    as_scored = scored_evals(evals, score_options.get("mate", "as_cp"))
    lookups = {"children": materialise(position_children(as_scored), "children"), "fens": materialise(fen_values(as_scored), "fens")}

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        scored = score_rollouts(batch, prompts, evals, **{**lookups, **score_options})
        # the folder name carries batch_id as a partition column when read back
        scored.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    writer = source.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
