"""Benchmark: runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line.

The derived inputs (records, prompts, rollouts, evaluations, token rows) are
written once first and timed apart (``prepare_sec``); each query is then timed
end to end (DataFrame construction, planning and a full run into Spark's
no-op sink, so every row and column is computed and nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rollout_tables.plans import inputs as I  # noqa: E402
from rollout_tables.plans.queries import QUERIES, forget  # noqa: E402
from rollout_tables.session import build_session  # noqa: E402

HEADLINE = [
    "reward_by_category",       # flagship: parse + lookups + rules + rollup
    "reward_all",
    "group_advantage",
    "reward_sort_fens",
    "positions_to_evaluate",
    "position_lookup",
    "completion_parse",
    "rl_prompts",
    "sft_messages",
    "split_4way_assign",
    "token_rows_masked",
    "conversation_text_chatml",
    "completion_lengths",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus))
    t = time.time()
    I.prepare(spark, sf_dir)
    prepare = time.time() - t
    times = {}
    for name in HEADLINE:
        forget()  # no query reads what another one has scored
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "prepare_sec": round(prepare, 3), "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
