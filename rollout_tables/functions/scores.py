"""Evaluation scaling (H1, H2, F8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollout_tables.fixed_values import LINEAR_SCALE_CP, MATE_OFFSET, SCORE_CLAMP_CP, TANH_SCALE_CP

CLAMP_CP = SCORE_CLAMP_CP


def _oriented(cp: Column, white_to_move: Column) -> Column:
    clamped = F.greatest(F.lit(-CLAMP_CP), F.least(F.lit(CLAMP_CP), cp))
    return F.when(white_to_move, clamped).otherwise(-clamped)


def scaled(cp: Column, white_to_move: Column | None = None) -> Column:
    """H2: tanh(score / 200) of the clamped, side-oriented score."""
    white_to_move = F.lit(True) if white_to_move is None else white_to_move
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.tanh(_oriented(cp, white_to_move) / F.lit(TANH_SCALE_CP))))


def linear(cp: Column, white_to_move: Column | None = None) -> Column:
    """H1: score / 500, clamped to [-1, 1]."""
    white_to_move = F.lit(True) if white_to_move is None else white_to_move
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _oriented(cp, white_to_move) / F.lit(LINEAR_SCALE_CP)))


def to_reward(cp: Column, white_to_move: Column, scaling: str = "tanh") -> Column:
    return linear(cp, white_to_move) if scaling == "linear" else scaled(cp, white_to_move)


def centipawns(eval_type: Column, eval_value: Column, mate: str = "as_cp") -> Column:
    """F8: mate scores on the centipawn scale (10000 + value) when
    ``mate='scaled'``; by default the value is read as centipawns, as the
    reward rules do."""
    if mate == "scaled":
        return F.when(eval_type == "mate", F.lit(MATE_OFFSET) + eval_value).otherwise(F.coalesce(eval_value, F.lit(0)))
    return eval_value
