"""Position resolution, work list and the evaluator hook."""

import pandas as pd
from pyspark.sql import functions as F

from helpers import evals_df, prompts_df, rollouts_df
from rollout_tables.operators.evals import EVAL_SCHEMA, evaluate_missing, positions_to_evaluate, resolve_positions


def test_resolve_with_start_fallback(spark):
    p = prompts_df(spark, [(1, "K", ["e2e4"]), (2, "K", []), (3, "K", ["e2e4", "?"]), (4, "K", None)])
    got = {r["record_id"]: r for r in resolve_positions(p, evals_df(spark)).collect()}
    assert got[1]["resolved_key"] == "e2e4" and got[1]["eval_value"] == 250 and got[1]["position_found"]
    for k in (2, 3, 4):
        assert got[k]["resolved_key"] == "" and got[k]["eval_value"] == 30 and got[k]["best_move"] == "e2e4"
    assert not got[3]["position_found"] and got[2]["position_found"]


def test_work_list_and_evaluator(spark):
    p = prompts_df(spark, [(1, "FIND_NEXT_BEST_MOVE", ["e2e4"]), (2, "SORT_FENS", ["d2d4"])])
    r = rollouts_df(spark, [("a", 1, '{"move": "g8f6"}'), ("b", 1, '{"move": "e7e5"}'),
                            ("c", 2, '{"sorted FENs": ["e2e4 b - 0", "new fen"]}')])
    work = positions_to_evaluate(p, r, evals_df(spark))
    got = {(x["kind"], x["key"]) for x in work.collect()}
    assert got == {("position", "e2e4 g8f6"), ("position", "d2d4"), ("fen", "new fen")}

    def evaluator(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"position_key": pdf["key"].where(pdf["kind"] == "position"),
                             "fen": pdf["key"].where(pdf["kind"] == "fen"), "eval_type": "cp",
                             "eval_value": 7, "best_move": "a2a3",
                             "top_moves": [[{"move": "a2a3", "score": 7, "mate": None, "depth": 1}]] * len(pdf)})

    out = evaluate_missing(work, evaluator)
    assert out.schema.simpleString() == spark.createDataFrame([], EVAL_SCHEMA).schema.simpleString()
    rows = out.collect()
    assert len(rows) == 3 and all(x["eval_value"] == 7 for x in rows)
    # appended to the table, the positions are no longer missing
    more = evals_df(spark).unionByName(out.filter(F.col("position_key").isNotNull()))
    assert {x["kind"] for x in positions_to_evaluate(p, r, more).collect()} == {"fen"}


def test_top_moves_from_lines(spark):
    from rollout_tables.operators.evals import top_moves_from_lines, top_n
    lines = spark.createDataFrame([("p", "a", 5), ("p", "b", 9), ("p", "c", 7), ("q", "x", 1)],
                                  "position_key string, move string, score int").withColumn(
        "mate", F.lit(None).cast("int")).withColumn("depth", F.lit(10))
    got = {r["position_key"]: r["t"] for r in
           top_moves_from_lines(lines, 2).select("position_key", top_n(F.col("top_moves"), 5).alias("t")).collect()}
    assert got == {"p": ["b", "c"], "q": ["x"]}
