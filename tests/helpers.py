"""Small in-test tables: a few positions with known evaluations."""

from rollout_tables.fixed_values import START_FEN

TOP = "array<struct<move:string,score:int,mate:int,depth:int>>"


def top(moves, base):
    return [{"move": m, "score": base - 10 * i, "mate": None, "depth": 15} for i, m in enumerate(moves)]


EVAL_ROWS = [
    ("", START_FEN, "cp", 30, "e2e4", top(["e2e4", "d2d4", "g1f3", "c2c4", "e2e3"], 30)),
    ("e2e4", "e2e4 b - 0", "cp", 250, "e7e5", top(["e7e5", "c7c5", "e7e6", "c7c6", "d7d5"], 250)),
    ("e2e4 e7e5", "e2e4 e7e5 w - 0", "cp", -600, "g1f3", top(["g1f3", "f1c4", "b1c3", "d2d4", "f2f4"], -600)),
    ("e2e4 c7c5", "e2e4 c7c5 w - 0", "cp", 40, "g1f3", top(["g1f3", "b1c3", "c2c3", "d2d4", "f2f4"], 40)),
]
EVAL_SCHEMA = f"position_key string, fen string, eval_type string, eval_value int, best_move string, top_moves {TOP}"


def evals_df(spark):
    return spark.createDataFrame(EVAL_ROWS, EVAL_SCHEMA)


def prompts_df(spark, rows):
    """rows: (record_id, category, moves list)"""
    return spark.createDataFrame(
        [(r, c, m, [], []) for r, c, m in rows],
        "record_id long, category string, moves array<string>, fens array<string>, "
        "prompt array<struct<role:string,content:string>>")


def rollouts_df(spark, rows):
    """rows: (rollout_id, prompt_id, completion)"""
    return spark.createDataFrame([(i, p, 0, c) for i, p, c in rows],
                                 "rollout_id string, prompt_id long, step long, completion string")
