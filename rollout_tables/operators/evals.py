"""Position lookups against an evaluation table.

``evals(position_key, fen, eval_type, eval_value, best_move, top_moves)`` is
an input: one row per position, keyed by the moves played from the start
(space separated, '' = start) and also addressable by ``fen``. A position
that is not in the table counts as invalid and falls back to the start
position, as the engine wrapper does for moves it cannot play.

Joins: positions are resolved once per prompt, not per rollout. The start
key '' is hot (every empty or invalid move list lands on it), so it never
enters the shuffle join: its row is read by a scalar subquery (one row,
computed once, inlined as a literal). Other hot keys are left to AQE's skew
join, which splits the large side; the evaluation side has one row per key.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.functions import scores

EVAL_COLUMNS = ["fen", "eval_type", "eval_value", "best_move", "top_moves"]
EVAL_SCHEMA = ("position_key string, fen string, eval_type string, eval_value int, best_move string, "
               "top_moves array<struct<move:string,score:int,mate:int,depth:int>>")


def position_key(moves: Column) -> Column:
    """the key of the position reached by ``moves`` from the start."""
    return F.array_join(F.coalesce(moves, F.array().cast("array<string>")), " ")


def top_n(top_moves: Column, n: int = 5) -> Column:
    """the first ``n`` candidate moves."""
    return F.transform(F.slice(F.coalesce(top_moves, F.array()), 1, n), lambda m: m["move"])


def top_moves_from_lines(lines: DataFrame, n: int = 5, key_col: str = "position_key") -> DataFrame:
    """F4 from long rows (one row per candidate line: ``move``, ``score``,
    ``mate``, ``depth``): the best ``n`` per position as the ``top_moves``
    array. A position has at most a few hundred legal moves, so the window
    partition is bounded by the game, not by the data."""
    from pyspark.sql import Window
    w = Window.partitionBy(key_col).orderBy(F.desc_nulls_last("score"), F.asc("move"))
    ranked = lines.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return ranked.groupBy(key_col).agg(F.sort_array(F.collect_list(F.struct(
        "_rank", "move", F.col("score").cast("int").alias("score"), F.col("mate").cast("int").alias("mate"),
        F.col("depth").cast("int").alias("depth")))).alias("_top")).select(
        key_col, F.transform("_top", lambda t: F.struct(t["move"].alias("move"), t["score"].alias("score"),
                                                         t["mate"].alias("mate"), t["depth"].alias("depth"))
                             ).alias("top_moves"))


def white_to_move(fen: Column, n_moves: Column | None = None) -> Column:
    """side to move of a FEN; move-count parity when there is no FEN."""
    if n_moves is None:
        return fen.contains(" w ")
    return F.when(fen.isNotNull(), fen.contains(" w ")).otherwise(n_moves % 2 == 0)


def _start_row(evals: DataFrame) -> dict[str, Column]:
    """The start position's evaluation as one scalar subquery (a struct),
    computed once and inlined; it fails loudly if the key is not unique."""
    start = evals.filter(F.col("position_key") == "").select(F.struct(*EVAL_COLUMNS).alias("s")).scalar()
    return {c: start[c] for c in EVAL_COLUMNS}


def resolve_positions(df: DataFrame, evals: DataFrame, moves_col: str = "moves") -> DataFrame:
    """Adds ``position_key``, ``position_found``, ``resolved_key`` and
    the evaluation columns of the resolved position."""
    ev = evals.select("position_key", *EVAL_COLUMNS)
    start = _start_row(ev)
    keyed = df.withColumn("position_key", position_key(F.col(moves_col)))
    rest = keyed.filter(F.col("position_key") != "")
    hit = rest.join(ev.filter(F.col("position_key") != "").withColumn("_found", F.lit(True)),
                    "position_key", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    cols = [c for c in keyed.columns]
    hit = hit.select(*cols, found.alias("position_found"),
                     F.when(found, F.col("position_key")).otherwise(F.lit("")).alias("resolved_key"),
                     *[F.when(found, F.col(c)).otherwise(start[c]).alias(c) for c in EVAL_COLUMNS])
    at_start = keyed.filter(F.col("position_key") == "").select(
        *cols, F.lit(True).alias("position_found"), F.lit("").alias("resolved_key"),
        *[start[c].alias(c) for c in EVAL_COLUMNS])
    return hit.unionByName(at_start)


def child_key(resolved_key: Column, move: Column) -> Column:
    """key of the position after ``move`` from the resolved position;
    null when there is no move to play."""
    return F.when(F.coalesce(move, F.lit("")) != "",
                  F.concat_ws(" ", F.nullif(resolved_key, F.lit("")), move))


def position_children(evals: DataFrame) -> DataFrame:
    """one row per position with its evaluated successors as parallel
    arrays (``child_moves``, ``child_cps``, ``child_white``). A group holds the
    legal moves of one position, at most a few hundred by the rules of the
    game. At scale write it to a table once: a join to a scan lets AQE split a
    hot position, a join to this aggregate does not."""
    key = F.col("position_key")
    move = F.substring_index(key, " ", -1)
    parent = F.substring(key, F.lit(1), F.length(key) - F.length(move) - 1)
    white = white_to_move(F.col("fen"), F.size(F.split(key, " ")))
    found = evals.filter(key != "").groupBy(parent.alias("parent_key")).agg(F.sort_array(F.collect_list(
        F.struct(move.alias("move"), F.col("eval_value").alias("cp"), white.alias("white")))).alias("c"))
    return found.select("parent_key", F.col("c.move").alias("child_moves"), F.col("c.cp").alias("child_cps"),
                        F.col("c.white").alias("child_white"))


def fen_values(evals: DataFrame) -> DataFrame:
    """one row per FEN (several move orders can reach one position). At
    scale write it to a table once, as ``position_children``."""
    return evals.filter(F.col("fen").isNotNull()).groupBy(F.col("fen").alias("fen_key")).agg(
        F.min_by("eval_value", "position_key").alias("fen_cp"))


def with_children(resolved: DataFrame, children: DataFrame, wanted: Column, row_id: str, move: Column | None = None) -> DataFrame:
    """Attaches the successors of the resolved position to the ``wanted``
    rows. The start position is read by a scalar subquery; all other rows get
    a unique non-matching key, so they do not pile up in one partition. Given
    a ``move``, only the successor by that move is kept of each list."""
    names = ["child_moves", "child_cps", "child_white"]
    start = children.filter(F.col("parent_key") == "").select(F.struct(*names).alias("s")).scalar()
    at_start = wanted & (F.col("resolved_key") == "")
    key = F.when(wanted & (F.col("resolved_key") != ""), F.col("resolved_key")).otherwise(
        F.concat(F.lit("\u0000"), F.col(row_id).cast("string")))
    joined = resolved.withColumn("parent_key", key).join(children, "parent_key", "left").drop("parent_key")
    lists = {n: F.when(at_start, start[n]).otherwise(F.col(n)) for n in names}
    if move is not None:
        place = F.nullif(F.array_position(lists["child_moves"], move), F.lit(0)).cast("int")
        lists = {n: F.slice(c, place, 1) for n, c in lists.items()}
    return joined.withColumns(lists)


def after_move(values: str, move: Column) -> Column:
    """F5 + F2 + F6: the entry of ``values`` (a ``with_children`` column) for
    the position after ``move``; null when there is no such position (text
    with a blank in it is not one move, so it is not playable)."""
    place = F.array_position(F.col("child_moves"), F.nullif(move, F.lit("")))
    return F.get(F.col(values), F.nullif(place, F.lit(0)).cast("int") - 1)


def positions_to_evaluate(prompts: DataFrame, rollouts: DataFrame, evals: DataFrame) -> DataFrame:
    """the distinct positions and FENs a rollout batch needs that the
    evaluation table does not have yet: prompt positions, positions after a
    predicted next move, and predicted FENs. Placeholder keys ('?') are not
    positions and are left out. Rollouts are scanned and parsed once and meet
    their prompt once; the needs are reduced to distinct keys before the anti
    join, so a hot position costs one row, not one per rollout."""
    from rollout_tables.operators.rewards import label_rollouts
    x = label_rollouts(rollouts, resolve_positions(prompts, evals), ["FIND_NEXT_BEST_MOVE", "SORT_FENS"])

    def need(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    move = F.when(F.col("json_state") != "non_object", F.col("pred_move"))
    needs = F.when(F.col("category") == "FIND_NEXT_BEST_MOVE",
                   F.array(need("position", child_key(F.col("resolved_key"), move)))).when(
        (F.col("category") == "SORT_FENS") & (F.size("pred_fens") >= 2),
        F.transform("pred_fens", lambda f: need("fen", f)))
    wanted = x.select(F.explode(needs).alias("n")).select("n.kind", "n.key").unionByName(
        prompts.select(F.lit("position").alias("kind"), position_key(F.col("moves")).alias("key")))
    wanted = wanted.filter(F.col("key").isNotNull() & ((F.col("kind") == "fen") | ~F.col("key").contains("?")))
    known = evals.select(F.explode(F.array(need("position", F.col("position_key")), need("fen", F.col("fen")))).alias("n"))
    return wanted.distinct().join(known.select("n.kind", "n.key"), ["kind", "key"], "left_anti")


def evaluate_missing(work: DataFrame, evaluator: Callable[[pd.DataFrame], pd.DataFrame],
                     schema: str = EVAL_SCHEMA) -> DataFrame:
    """runs a user evaluator over the work list, one Arrow batch at a
    time in each task (an engine process per task, not per row). The
    evaluator takes a pandas frame with ``kind`` and ``key`` and returns rows
    of ``schema``; its output can be appended to the evaluation table."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield evaluator(pdf)
    return work.mapInPandas(run, schema)


def scored_evals(evals: DataFrame, mate: str = "as_cp") -> DataFrame:
    """F8: the evaluations as the reward rules read them."""
    return evals.withColumn("eval_value", scores.centipawns(F.col("eval_type"), F.col("eval_value"), mate))


def mate_scaled(df: DataFrame) -> DataFrame:
    """F8 as a column on resolved rows."""
    return df.withColumn("cp_scaled", scores.centipawns(F.col("eval_type"), F.col("eval_value"), mate="scaled"))
