"""REWARD job: parsed rollouts + resolved positions -> one reward per
rollout (G1-G10, with H1/H2 scaling).

One pass over the rollouts: where a completion is scanned, the object in it is
found and only that travels on with a few short labels; the rows meet their
resolved prompt once, and behind it the one label that the category's rule
reads is taken from the object. The prompt brings only what its category's rule
reads. The position after a predicted move is looked up behind that, in the
successor arrays of the resolved position: a prompt that brought these along
would carry every known successor through the join. Only FIND_NEXT_BEST_MOVE
and SORT_FENS need another lookup, and only their rows pass it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.fixed_values import (
    ADVANTAGE_DRAW_PARTIAL, ADVANTAGE_EXPECTED_CP, ADVANTAGE_TIERS, ADVANTAGE_WRONG_FLOOR, FINAL_SCORE_DRAW_PARTIAL,
    FINAL_SCORE_EXPECTED_CP, FINAL_SCORE_TIERS, FINAL_SCORE_WRONG_FLOOR, LAST_MOVE_BEST, LAST_MOVE_NONE,
    LAST_MOVE_OTHER, LAST_MOVE_TOP, LIST_BASE, LIST_SPAN, NEXT_MOVE_FAILURE, PARSE_FAILURE, PENALTY_DECAY_TOKENS,
    PENALTY_FREE_TOKENS, PENALTY_SCALE, SCORE_LABELS, TOP_N_MOVES,
)
from rollout_tables.functions import scores
from rollout_tables.operators.evals import (
    after_move, fen_values, position_children, resolve_positions, scored_evals, top_n, with_children,
)
from rollout_tables.operators.objects import is_stored, read_labels
from rollout_tables.operators.parse import PARSED_COLUMNS, label_by_category, parse_completions, scan_completions
from rollout_tables.session import TABLE_CODEC, materialise

NEXT, ADV, FINAL, MLM, LAST, SORT = ("FIND_NEXT_BEST_MOVE", "FIND_ADVANTAGED_PLAYER", "FIND_FINAL_SCORE",
                                    "MLM_ON_MOVES", "FIND_LAST_MOVE", "SORT_FENS")
OUTPUT_COLUMNS = ["rollout_id", "prompt_id", "step", "category", "json_state", "position_found",
                  "reward_raw", "think_tokens", "penalty", "reward"]


def _cp() -> Column:
    return F.coalesce(F.col("eval_value"), F.lit(0))


def _tiered(cp: Column, s: Column, tiers) -> Column:
    """max(floor, factor * s) for the first tier whose |cp| bound is exceeded."""
    chain = None
    for bound, floor, factor in tiers:
        value = F.greatest(F.lit(floor), s * factor)
        if bound is None:
            return chain.otherwise(value)
        cond = F.abs(cp) > bound
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def rule_next_best_move(scaling: str = "tanh") -> Column:
    """G1: the evaluation after the predicted move, from the side then to
    move; -0.1 when the move cannot be played or the text is a JSON scalar."""
    move = F.col("pred_move")
    cp = after_move("child_cps", move)
    return F.when((F.col("json_state") != "non_object") & cp.isNotNull(),
                  scores.to_reward(cp, after_move("child_white", move), scaling)).otherwise(F.lit(NEXT_MOVE_FAILURE))


def rule_advantaged_player(draw_partial_credit: bool = False) -> Column:
    """G2."""
    cp = _cp()
    s = scores.scaled(cp)
    expected = F.when(cp > ADVANTAGE_EXPECTED_CP, "white").when(cp < -ADVANTAGE_EXPECTED_CP, "black") \
        .otherwise("draw")
    label = F.col("pred_advantage")
    wrong = F.greatest(F.lit(ADVANTAGE_WRONG_FLOOR), -F.abs(s))
    if draw_partial_credit:
        wrong = F.when((label == "draw") | (expected == "draw"), F.lit(ADVANTAGE_DRAW_PARTIAL)).otherwise(wrong)
    return (F.when(F.col("json_state") == "non_object", F.lit(PARSE_FAILURE))
            .when(label == expected, _tiered(cp, s, ADVANTAGE_TIERS)).otherwise(wrong))


def rule_final_score() -> Column:
    """G3."""
    cp = _cp()
    s = scores.scaled(cp)
    win, loss, draw = SCORE_LABELS
    expected = F.when(cp > FINAL_SCORE_EXPECTED_CP, win).when(cp < -FINAL_SCORE_EXPECTED_CP, loss).otherwise(draw)
    label = F.col("pred_score")
    wrong = F.when((label == draw) | (expected == draw), F.lit(FINAL_SCORE_DRAW_PARTIAL)) \
        .otherwise(F.greatest(F.lit(FINAL_SCORE_WRONG_FLOOR), -F.abs(s)))
    return (F.when(F.col("json_state") == "non_object", F.lit(PARSE_FAILURE))
            .when(label == expected, _tiered(cp, s, FINAL_SCORE_TIERS)).otherwise(wrong))


def rule_missing_moves() -> Column:
    """Share of predicted moves (repeats count) that are the best move or
    among the top five, mapped to [0.5, 1]."""
    pred, top5, best = F.col("pred_missing"), top_n(F.col("top_moves"), TOP_N_MOVES), F.col("best_move")
    good = F.size(F.filter(pred, lambda m: F.array_contains(top5, m) | (m == best)))
    return (F.when((F.col("json_state") != "object") | pred.isNull() | (F.size(pred) == 0), F.lit(PARSE_FAILURE))
            .otherwise(F.lit(LIST_BASE) + F.lit(LIST_SPAN) * good / F.size(pred)))


def rule_last_move() -> Column:
    """G5."""
    mv, top5 = F.col("pred_move"), top_n(F.col("top_moves"), TOP_N_MOVES)
    return (F.when(F.col("json_state") == "non_object", F.lit(PARSE_FAILURE))
            .when(F.coalesce(mv, F.lit("")) == "", F.lit(LAST_MOVE_NONE))
            .when(mv == F.col("best_move"), F.lit(LAST_MOVE_BEST))
            .when(F.array_contains(top5, mv), F.lit(LAST_MOVE_TOP))
            .otherwise(F.lit(LAST_MOVE_OTHER)))


def rule_sort_fens() -> Column:
    """G6 for a usable list, given its length ``n_fens`` and ``valid_count``
    from ``sort_fen_counts``; any other answer scores as a parse failure."""
    return F.lit(LIST_BASE) + F.lit(LIST_SPAN) * F.col("valid_count") / F.col("n_fens")


def reasoning_penalty(tokens: Column) -> Column:
    """Nothing up to 500 reasoning tokens, then up to 0.1."""
    over = tokens - F.lit(PENALTY_FREE_TOKENS)
    return F.when(tokens > PENALTY_FREE_TOKENS,
                  F.lit(PENALTY_SCALE) * (F.lit(1.0) - F.exp(-over / F.lit(float(PENALTY_DECAY_TOKENS))))) \
        .otherwise(F.lit(0.0))


def non_falling(values: Column) -> Column:
    """How many of a list's evaluations are at least as high as the one
    before that could be evaluated (the first always counts, nulls are skipped)."""
    state = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("count"))

    def step(s, v):
        good = (v.isNotNull() & (s["last"].isNull() | (v >= s["last"]))).cast("long")
        return F.struct(F.coalesce(v, s["last"]).alias("last"), (s["count"] + good).alias("count"))

    return F.aggregate(values, state, step, lambda s: s["count"])


def sort_fen_counts(rows: DataFrame, fens: DataFrame, row_col: str) -> DataFrame:
    """G6 + F7: every row with ``valid_count`` in place of its ``pred_fens``.
    ``row_col`` is a unique number of the row in a written table. The FENs meet
    their evaluations by a join, come back as one list a row (as long as the
    predicted list) and are walked by a fold; the other columns ride along
    with the first FEN."""
    keep = [c for c in rows.columns if c not in ("pred_fens", row_col)]
    carried = F.struct(*keep)
    ex = rows.select(row_col, carried.alias("_carried"), F.posexplode("pred_fens").alias("pos", "fen_key"))
    ex = ex.withColumn("_carried", F.when(F.col("pos") == 0, F.col("_carried"))).join(fens, "fen_key", "left")
    out = ex.groupBy(row_col).agg(F.any_value("_carried", True).alias("_carried"),
                                  F.sort_array(F.collect_list(F.struct("pos", "fen_cp"))).alias("_walk"))
    return out.select("_carried.*", non_falling(F.col("_walk.fen_cp")).alias("valid_count"))


def parsed_rollouts(rollouts: DataFrame, strip_think: bool = False) -> DataFrame:
    """All labels of every rollout instead of the completion (for rules of
    user categories, which may read any). Of a score label only the known ones
    matter to the rules; any other text (possibly the whole completion)
    becomes ``''``."""
    return known_scores(parse_completions(_narrow(rollouts), strip_think=strip_think).drop("completion"))


def known_scores(parsed: DataFrame) -> DataFrame:
    score = F.col("pred_score")
    return parsed.select("rollout_id", "prompt_id", "step", *[c for c in PARSED_COLUMNS if c != "pred_score"],
                         F.when(score.isin(*SCORE_LABELS), score).otherwise(F.lit("")).alias("pred_score"))


def _narrow(rollouts: DataFrame) -> DataFrame:
    return rollouts.select("rollout_id", "prompt_id", "step", "completion")


def label_rollouts(rollouts: DataFrame, resolved_prompts: DataFrame, categories: list[str] | None = None,
                   strip_think: bool = False) -> DataFrame:
    """E1-E9 + G8: every rollout with its prompt's columns and the labels of
    its own category. Completions are read once; only the text of the found
    object and a few short labels pass the join, and one label is read behind
    it."""
    x = join_prompts(scan_completions(_narrow(rollouts), strip_think=strip_think), resolved_prompts)
    if categories is not None:
        x = x.filter(F.col("category").isin(*categories))
    return label_by_category(x, categories)


def join_prompts(parsed: DataFrame, resolved_prompts: DataFrame) -> DataFrame:
    """Every rollout meets its prompt's category and resolved position
    (the original code aligns them by list position). A rollout whose prompt
    is missing or null stays, with category ``''`` (reward 0.0)."""
    pr = resolved_prompts
    if "record_id" in pr.columns and "prompt_id" not in pr.columns:
        pr = pr.withColumnRenamed("record_id", "prompt_id")
    joined = parsed.join(pr.drop("prompt"), "prompt_id", "left")
    return joined.withColumns({"category": F.coalesce(F.col("category"), F.lit("")),
                               "position_found": F.coalesce(F.col("position_found"), F.lit(False))})


def _of_own_rule(resolved: DataFrame) -> DataFrame:
    """Resolved prompts with only what the rule of their own category reads
    of the evaluation: they pass the join to the rollouts."""
    def of(value, *names):
        return F.when(F.col("category").isin(*names), value)

    moves = F.transform(F.slice("top_moves", 1, TOP_N_MOVES), lambda m: F.struct(m["move"].alias("move")))
    return resolved.select("prompt_id", "category", "position_found", of(F.col("resolved_key"), NEXT).alias("resolved_key"),
                           of(F.col("eval_value"), ADV, FINAL).alias("eval_value"),
                           of(F.col("best_move"), MLM, LAST).alias("best_move"), of(moves, MLM, LAST).alias("top_moves"))


def score_rollouts(rollouts: DataFrame, prompts: DataFrame, evals: DataFrame, scaling: str = "tanh",
                   draw_partial_credit: bool = False, extra_rules: dict[str, Column] | None = None,
                   categories: list[str] | None = None, mate: str = "as_cp", children: DataFrame | None = None,
                   fens: DataFrame | None = None, strip_think: bool = False) -> DataFrame:
    """G7 + G8 + G9: one row per rollout with the category reward
    (``reward_raw``), the reasoning penalty and the final ``reward``.

    ``rollouts`` has ``rollout_id``, ``prompt_id``, ``step``, ``completion``, or
    is a written table of ``objects.stored_answers``, which is not parsed again (and fixes ``strip_think``);
    ``prompts`` is the output of ``rl_prompts`` (``record_id`` = prompt id);
    ``extra_rules`` maps further categories to reward columns (K3);
    ``categories`` restricts the job to those categories; ``mate="scaled"``
    puts mate scores on the centipawn scale (F8); ``strip_think`` reads the
    answer outside the reasoning block only (Q9). ``children`` and ``fens``
    are the written tables of ``position_children`` and ``fen_values`` of the
    evaluations as scored (after ``scored_evals`` if mates are scaled); they
    are derived here when not given.

    Plan: one scan of the rollouts; one join to the resolved prompts; one
    projection. Where SORT_FENS is wanted, the narrow rows are then written
    once (under ``spark.checkpoint.dir``, while this frame is built), and only
    those with a usable FEN list pass the FEN lookup, only predicted next moves
    that to the successors; all others are read back as they are.
    """
    evals = scored_evals(evals, mate)
    cat = F.col("category")

    def wanted(name):
        return categories is None or name in categories

    pr = resolve_positions(prompts, evals)
    if "record_id" in pr.columns and "prompt_id" not in pr.columns:
        pr = pr.withColumnRenamed("record_id", "prompt_id")
    if not extra_rules:
        pr = _of_own_rule(pr)
    if is_stored(rollouts):
        x = join_prompts(known_scores(read_labels(rollouts, None if extra_rules else categories)), pr)
        x = x if categories is None else x.filter(cat.isin(*categories))
    elif extra_rules:
        x = join_prompts(parsed_rollouts(rollouts, strip_think), pr)
        x = x if categories is None else x.filter(cat.isin(*categories))
    else:
        x = label_rollouts(rollouts, pr, categories, strip_think)
    rules = {ADV: rule_advantaged_player(draw_partial_credit), FINAL: rule_final_score(),
             MLM: rule_missing_moves(), LAST: rule_last_move(), SORT: F.lit(PARSE_FAILURE)}
    children = position_children(evals) if children is None and wanted(NEXT) else children
    if wanted(NEXT) and not wanted(SORT):
        x = with_children(x, children, cat == NEXT, "rollout_id", F.col("pred_move"))
        rules[NEXT] = rule_next_best_move(scaling)
    rules = {name: rule for name, rule in rules.items() if wanted(name)}
    known = {NEXT, SORT, ADV, FINAL, MLM, LAST}
    rules.update({name: rule for name, rule in (extra_rules or {}).items() if name not in known and wanted(name)})
    reward = F.lit(0.0)
    for name, rule in rules.items():
        reward = F.when(cat == name, rule.cast("double")).otherwise(reward)
    keep = [c for c in OUTPUT_COLUMNS if c not in ("penalty", "reward")]
    x = x.withColumn("reward_raw", reward)
    if wanted(SORT):
        usable = (cat == SORT) & (F.col("json_state") == "object") & (F.size("pred_fens") >= 2)
        of_next = [F.when(cat == NEXT, F.col(c)).alias(c) for c in ("resolved_key", "pred_move") if wanted(NEXT)]
        x = materialise(x.select(*keep, F.when(usable, F.col("pred_fens")).alias("pred_fens"), *of_next,
                                 F.monotonically_increasing_id().alias("_row")), "labelled", TABLE_CODEC)
        lists = x.filter(F.col("pred_fens").isNotNull()).withColumn("n_fens", F.size("pred_fens"))
        walked = sort_fen_counts(lists, fen_values(evals) if fens is None else fens, "_row")
        others = x.filter(F.col("pred_fens").isNull() & ((cat != NEXT) if wanted(NEXT) else F.lit(True))).select(*keep)
        others = others.unionByName(walked.withColumn("reward_raw", rule_sort_fens()).select(*keep))
        if wanted(NEXT):
            moves = with_children(x.filter(cat == NEXT), children, F.lit(True), "rollout_id", F.col("pred_move"))
            others = others.unionByName(moves.withColumn("reward_raw", rule_next_best_move(scaling)).select(*keep))
        x = others
    out = x.select(*keep).withColumn("penalty", reasoning_penalty(F.col("think_tokens")))
    return out.withColumn("reward", F.col("reward_raw") - F.col("penalty"))


def weighted_rewards(scored: DataFrame, weights: DataFrame, default_weight: float = 1.0) -> DataFrame:
    """Attaches the category weight; of a category listed more than once
    the largest weight holds."""
    w = weights.groupBy("category").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    return scored.join(w, "category", "left").withColumn(
        "weight", F.coalesce(F.col("weight"), F.lit(default_weight)))
