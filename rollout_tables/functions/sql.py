"""The scaling and rule arithmetic as SQL functions, so that reports and rules
of one's own can be written in SQL:

    register(spark)
    spark.sql("SELECT category, avg(rule_final_score(json_state, pred_score, eval_value)) FROM ... GROUP BY category")

They are temporary SQL functions of the session: Spark inlines their bodies,
no Python runs. All numbers come from ``fixed_values``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from rollout_tables.fixed_values import (
    ADVANTAGE_DRAW_PARTIAL, ADVANTAGE_EXPECTED_CP, ADVANTAGE_TIERS, ADVANTAGE_WRONG_FLOOR, CHARS_PER_TOKEN,
    FINAL_SCORE_DRAW_PARTIAL, FINAL_SCORE_EXPECTED_CP, FINAL_SCORE_TIERS, FINAL_SCORE_WRONG_FLOOR, LAST_MOVE_BEST,
    LAST_MOVE_NONE, LAST_MOVE_OTHER, LAST_MOVE_TOP, LINEAR_SCALE_CP, MATE_OFFSET, PARSE_FAILURE, PENALTY_DECAY_TOKENS,
    PENALTY_FREE_TOKENS, PENALTY_SCALE, SCORE_CLAMP_CP, SCORE_LABELS, TANH_SCALE_CP, THINK_CLOSE, THINK_OPEN,
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _tiers(tiers) -> str:
    """The first tier whose bound |cp| exceeds gives the reward."""
    whens = "".join(f" WHEN abs(coalesce(cp, 0)) > {bound} THEN greatest({floor}D, reward_scaled(coalesce(cp, 0), true) * {factor}D)"
                    for bound, floor, factor in tiers if bound is not None)
    _, floor, factor = tiers[-1]
    return f"CASE{whens} ELSE greatest({floor}D, reward_scaled(coalesce(cp, 0), true) * {factor}D) END"


def definitions() -> dict[str, str]:
    """Signature to body, each using only those before it."""
    win, loss, draw = (_quoted(x) for x in SCORE_LABELS)
    clamped = f"greatest(-{SCORE_CLAMP_CP}, least({SCORE_CLAMP_CP}, cp))"
    seen = f"CASE WHEN white THEN {clamped} ELSE -{clamped} END"
    start, body = f"locate({_quoted(THINK_OPEN)}, completion)", len(THINK_OPEN)
    end = f"locate({_quoted(THINK_CLOSE)}, completion, {start} + {body})"
    return {
        "centipawns(kind STRING, value INT, scale_mates BOOLEAN) RETURNS INT":  # F8
            f"CASE WHEN kind = 'mate' AND scale_mates THEN {MATE_OFFSET} + value ELSE coalesce(value, 0) END",
        "reward_scaled(cp INT, white BOOLEAN) RETURNS DOUBLE":  # H2
            f"greatest(-1D, least(1D, tanh(({seen}) / {TANH_SCALE_CP}D)))",
        "reward_linear(cp INT, white BOOLEAN) RETURNS DOUBLE":  # H1
            f"greatest(-1D, least(1D, ({seen}) / {LINEAR_SCALE_CP}D))",
        "think_token_count(completion STRING) RETURNS DOUBLE":  # E9
            f"CASE WHEN {start} > 0 AND {end} > 0 THEN ({end} - {start} - {body}) / {float(CHARS_PER_TOKEN)}D ELSE 0D END",
        "reasoning_penalty(tokens DOUBLE) RETURNS DOUBLE":  # G9
            f"CASE WHEN tokens > {PENALTY_FREE_TOKENS} THEN {PENALTY_SCALE}D * (1D - exp(-(tokens - {PENALTY_FREE_TOKENS}) / {float(PENALTY_DECAY_TOKENS)}D)) ELSE 0D END",
        "expected_advantage(cp INT) RETURNS STRING":
            f"CASE WHEN coalesce(cp, 0) > {ADVANTAGE_EXPECTED_CP} THEN 'white' WHEN coalesce(cp, 0) < -{ADVANTAGE_EXPECTED_CP} THEN 'black' ELSE 'draw' END",
        "expected_score(cp INT) RETURNS STRING":
            f"CASE WHEN coalesce(cp, 0) > {FINAL_SCORE_EXPECTED_CP} THEN {win} WHEN coalesce(cp, 0) < -{FINAL_SCORE_EXPECTED_CP} THEN {loss} ELSE {draw} END",
        "rule_advantaged_player(json_state STRING, label STRING, cp INT, draw_credit BOOLEAN) RETURNS DOUBLE":  # G2
            f"CASE WHEN json_state = 'non_object' THEN {PARSE_FAILURE}D WHEN label = expected_advantage(cp) THEN {_tiers(ADVANTAGE_TIERS)} "
            f"WHEN draw_credit AND (label = 'draw' OR expected_advantage(cp) = 'draw') THEN {ADVANTAGE_DRAW_PARTIAL}D "
            f"ELSE greatest({ADVANTAGE_WRONG_FLOOR}D, -abs(reward_scaled(coalesce(cp, 0), true))) END",
        "rule_final_score(json_state STRING, label STRING, cp INT) RETURNS DOUBLE":  # G3
            f"CASE WHEN json_state = 'non_object' THEN {PARSE_FAILURE}D WHEN label = expected_score(cp) THEN {_tiers(FINAL_SCORE_TIERS)} "
            f"WHEN label = {draw} OR expected_score(cp) = {draw} THEN {FINAL_SCORE_DRAW_PARTIAL}D "
            f"ELSE greatest({FINAL_SCORE_WRONG_FLOOR}D, -abs(reward_scaled(coalesce(cp, 0), true))) END",
        "rule_last_move(json_state STRING, move STRING, best STRING, top ARRAY<STRING>) RETURNS DOUBLE":  # G5
            f"CASE WHEN json_state = 'non_object' THEN {PARSE_FAILURE}D WHEN coalesce(move, '') = '' THEN {LAST_MOVE_NONE}D "
            f"WHEN move = best THEN {LAST_MOVE_BEST}D WHEN array_contains(top, move) THEN {LAST_MOVE_TOP}D ELSE {LAST_MOVE_OTHER}D END",
    }


def register(spark: SparkSession) -> list[str]:
    """Defines the functions in the session and returns their names."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in definitions()]
