"""Registered queries: one per operator group of the survey (§7.4).

Each takes ``(spark, sf_dir)`` and returns a flat DataFrame (arrays joined
into strings, doubles rounded to 6 digits) so that its rows can be compared
with the SQL oracle in ``plans.oracle``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from rollout_tables.fixed_values import SPLITS_4WAY, THINK_CLOSE
from rollout_tables.functions.chat import flatten_messages, render_chatml, render_llama3
from rollout_tables.functions.sql import register
from rollout_tables.operators import evals as EV
from rollout_tables.operators import ledger as L
from rollout_tables.operators import messages as M
from rollout_tables.operators import reports as R
from rollout_tables.operators import rewards as G
from rollout_tables.operators import sketches as SK
from rollout_tables.operators import splits as S
from rollout_tables.operators.conversations import masked_conversations
from rollout_tables.operators.objects import read_labels
from rollout_tables.operators.parse import parse_completions
from rollout_tables.operators.tokens import mask_token_rows, token_audit
from rollout_tables.plans import inputs as I
from rollout_tables.session import checkpoint_dir, materialise
from rollout_tables.sources import datasets as DS
from rollout_tables.sources import fixtures as fx
from rollout_tables.sources.footers import footer_counts

TOKEN_LEN = fx.TOKEN_ROW_LENGTH


def flat(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 digits, for value comparison with the oracle."""
    cols = [F.round(F.col(f.name), 6).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _join(c, sep):
    return F.array_join(c, sep)


# --- SPLIT -----------------------------------------------------------------

def split_3way_assign(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return S.split_3way(docs, "doc_id").select("doc_id", "split_rank", "split")


def split_4way_assign(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return S.split_4way(docs, "doc_id").select("doc_id", "split_rank", "split")


def split_4way_unranked(spark, sf):
    """The form the split job runs, over repeated ids; a seventh of the rows
    has none, so that borders fall within rows of one id."""
    li = fx.table(spark, sf, "lineitem").select(F.when(F.col("l_partkey") % 7 != 0, F.col("l_orderkey")).alias("record_id"))
    return S.split_4way(li, "record_id", with_rank=False).select("record_id", "split")


def split_size_report(spark, sf):
    labels = fx.table(spark, sf, "labels").select("doc_id")
    return flat(S.size_report(S.split_3way(labels, "doc_id")).select("split", "split_order", "n", "pct"))


def split_size_report_footers(spark, sf):
    """D6 over a table written by split: the counts come from its footers."""
    path = os.path.join(checkpoint_dir(spark), "derived", spark.sparkContext.applicationId, f"splits-{uuid.uuid4().hex}")
    docs = fx.table(spark, sf, "documents").select("doc_id")
    DS.write_splits(S.split_4way(docs, "doc_id", with_rank=False), path)
    return flat(S.size_report_of(footer_counts(spark, path, ["split"]), SPLITS_4WAY).select("split", "split_order", "n", "pct"))


def split_resolve(spark, sf):
    docs = S.split_4way(fx.table(spark, sf, "documents").select("doc_id"), "doc_id")
    train = DS.sft_train_split(docs, "sft_train").withColumn("use", F.lit("train"))
    val = DS.val_split(docs, "sft_val").withColumn("use", F.lit("eval"))
    return train.unionByName(val).select("doc_id", "split", "use")


def split_resolve_rl(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    named = S.split_4way(docs, "doc_id").select("doc_id", "split")
    plain = named.replace({"sft_train": "train"}, subset=["split"])
    out = None
    for arm, df, name in (("requested", named, "rl"), ("train", plain, "absent"), ("whole", docs, "rl")):
        picked, has_eval = DS.rl_train_split(df, name)
        part = picked.select("doc_id", F.lit(arm).alias("arm"), F.lit(has_eval).alias("has_eval"))
        out = part if out is None else out.unionByName(part)
    return out


# --- PREP ------------------------------------------------------------------

def sft_messages(spark, sf):
    out = M.sft_messages(I.records(spark, sf))
    return out.select("record_id", F.size("messages").cast("long").alias("n_messages"),
                      flatten_messages(F.col("messages")).alias("messages"), "text")


def rl_prompts(spark, sf):
    p = M.rl_prompts(I.records(spark, sf))
    return p.select("record_id", "category", _join(F.col("moves"), " ").alias("moves"),
                    _join(F.col("fens"), "|").alias("fens"),
                    F.size("prompt").cast("long").alias("n_messages"),
                    flatten_messages(F.col("prompt")).alias("prompt"))


def rl_prompts_with_answer(spark, sf):
    out = M.rl_prompts_with_answer(I.records(spark, sf))
    return out.select("record_id", F.size("messages").cast("long").alias("n_messages"),
                      flatten_messages(F.col("messages")).alias("messages"), "text")


def conversation_text_chatml(spark, sf):
    conv = M.conversation_messages(fx.table(spark, sf, "conversations"))
    return conv.select("conv_id", render_chatml(F.col("messages"), add_generation_prompt=True).alias("text"))


def conversation_text_llama3(spark, sf):
    conv = M.conversation_messages(fx.table(spark, sf, "conversations"))
    return conv.select("conv_id", render_llama3(F.col("messages"), add_generation_prompt=True).alias("text"))


def _masked(spark, sf, rule="answer"):
    return mask_token_rows(I.token_rows(spark, sf), TOKEN_LEN, fx.PAD_ID, rule)


def token_rows_last_header(spark, sf):
    return token_rows_masked(spark, sf, "last_header")


def token_rows_masked(spark, sf, rule="answer"):
    return _token_columns(_masked(spark, sf, rule))


def _token_columns(m):
    return m.select("conv_id", F.col("n_ids").cast("long").alias("n_ids"), F.col("n_real").cast("long").alias("n_real"),
                    F.col("answer_start").cast("long").alias("answer_start"),
                    _join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_attended"),
                    _join(F.col("labels").cast("array<string>"), ",").alias("labels"))


def token_rows_by_turn(spark, sf):
    """The masked rows from turns, of which only those that begin before the
    row's length are gathered."""
    return _token_columns(masked_conversations(fx.turn_tokens(spark, sf), "ids", TOKEN_LEN, fx.PAD_ID))


def token_audit_q(spark, sf):
    return flat(token_audit(_masked(spark, sf), TOKEN_LEN))


# --- PARSE -----------------------------------------------------------------

def completion_parse(spark, sf):
    p = parse_completions(I.rollouts(spark, sf))
    return flat(p.select("rollout_id", "json_state", "pred_move", "pred_advantage", "pred_score", "think_tokens"))


def completion_parse_messages(spark, sf):
    """Completions given as chat messages, here cut in two."""
    c = F.col("completion")
    half = F.floor(F.length(c) / 2).cast("int")

    def message(content):
        return F.struct(F.lit("assistant").alias("role"), content.alias("content"))

    cut = F.array(message(F.substring(c, F.lit(1), half)), message(F.substring(c, half + 1, F.length(c))), message(F.lit(None).cast("string")))
    p = parse_completions(I.rollouts(spark, sf).withColumn("completion", cut))
    return flat(p.select("rollout_id", "json_state", "pred_move", "pred_advantage", "pred_score", "think_tokens"))


def completion_parse_strip_think(spark, sf):
    """Q9: an object in the reasoning block does not hide the answer."""
    hidden = F.replace(F.col("completion"), F.lit(THINK_CLOSE), F.lit('{"move": "a1a1", "score": "1-0"}' + THINK_CLOSE))
    p = parse_completions(I.rollouts(spark, sf).withColumn("completion", hidden), strip_think=True)
    return flat(p.select("rollout_id", "json_state", "pred_move", "pred_advantage", "pred_score", "think_tokens"))


def completion_lists(spark, sf):
    return _lists(parse_completions(I.rollouts(spark, sf)))


def _lists(p):
    return p.select("rollout_id", "json_state", _join(F.col("pred_missing"), "|").alias("pred_missing"),
                    F.size("pred_missing").cast("long").alias("n_missing"),
                    _join(F.col("pred_fens"), "|").alias("pred_fens"),
                    F.size("pred_fens").cast("long").alias("n_fens"))


def completion_parse_stored(spark, sf):
    """The parse from answers stored as shredded variants."""
    p = read_labels(I.answers(spark, sf))
    return flat(p.select("rollout_id", "json_state", "pred_move", "pred_advantage", "pred_score", "think_tokens"))


def completion_lists_stored(spark, sf):
    return _lists(read_labels(I.answers(spark, sf), ["MLM_ON_MOVES", "SORT_FENS"]))


# --- LOOKUPS ---------------------------------------------------------------

def positions_to_evaluate(spark, sf):
    return EV.positions_to_evaluate(I.prompts(spark, sf), I.rollouts(spark, sf), I.evals(spark, sf))


def position_lookup_indexed(spark, sf):
    return position_lookup(spark, sf, I.index(spark, sf).evals)


def position_lookup(spark, sf, evals=None):
    r = EV.mate_scaled(EV.resolve_positions(I.prompts(spark, sf), I.evals(spark, sf) if evals is None else evals))
    return r.select("record_id", "position_key", "position_found", "resolved_key", "eval_type",
                    F.col("eval_value").cast("long").alias("eval_value"), F.col("cp_scaled").cast("long").alias("cp_scaled"),
                    "best_move", _join(EV.top_n(F.col("top_moves"), 3), " ").alias("top3"),
                    EV.white_to_move(F.col("fen"), F.size("moves")).alias("white_to_move"))


def evaluation_ledger(spark, sf):
    """Two batches merged one after the other: the second evaluates the mates
    anew and adds FENs by themselves; then what of a work list is missing."""
    path = os.path.join(checkpoint_dir(spark), "derived", spark.sparkContext.applicationId, f"ledger-{uuid.uuid4().hex}")
    evals = I.evals(spark, sf)
    L.merge(path, evals)
    again = evals.filter("eval_type = 'mate'").withColumn("eval_value", F.col("eval_value") + 1000)
    by_fen = evals.filter("length(position_key) < 12").withColumn("position_key", F.lit(None).cast("string"))
    L.merge(path, again.unionByName(by_fen))
    work = evals.select(F.lit("fen").alias("kind"), F.col("fen").alias("key")).unionByName(
        evals.select(F.lit("position").alias("kind"), F.col("position_key").alias("key")))
    lacking = L.missing(path, work).select("kind", "key", F.lit(None).cast("int").alias("eval_value"), F.lit(False).alias("known"))
    return L.read(spark, path).select("kind", "key", "eval_value", F.lit(True).alias("known")).unionByName(lacking)


# --- REWARD ----------------------------------------------------------------

_SCORED: dict[tuple, DataFrame] = {}


def forget() -> None:
    """The next query labels and scores anew (the benchmark times it whole)."""
    _SCORED.clear()


def _scored(spark, sf, **kw):
    """The REWARD job over the derived inputs, built once per session, input
    and options; its labelled rows are written once."""
    key = (spark.sparkContext.applicationId, sf, tuple(sorted((k, repr(v)) for k, v in kw.items())))
    if key not in _SCORED:
        if "mate" not in kw:  # the written tables hold the evaluations as they are
            kw = dict(kw, children=I.children(spark, sf), fens=I.fens(spark, sf))
        _SCORED[key] = G.score_rollouts(I.rollouts(spark, sf), I.prompts(spark, sf), I.evals(spark, sf), **kw)
    return _SCORED[key]


def _reward_of(category, **kw):
    def q(spark, sf):
        s = _scored(spark, sf, categories=[category], **kw)
        return flat(s.select("rollout_id", "prompt_id", "json_state", "position_found", "reward_raw"))
    q.__name__ = f"reward_{category.lower()}"
    return q


reward_next_move = _reward_of(G.NEXT)
reward_advantage = _reward_of(G.ADV)
reward_final_score = _reward_of(G.FINAL)
reward_missing_moves = _reward_of(G.MLM)
reward_last_move = _reward_of(G.LAST)
reward_sort_fens = _reward_of(G.SORT)
reward_linear = _reward_of(G.NEXT, scaling="linear")
reward_advantage_draw_credit = _reward_of(G.ADV, draw_partial_credit=True)


def _sql_rule(category, rule):
    """A rule in plain SQL over the registered functions."""
    def q(spark, sf):
        register(spark)
        parse_completions(I.rollouts(spark, sf)).createOrReplaceTempView("parsed_rollouts")
        EV.resolve_positions(I.prompts(spark, sf), I.evals(spark, sf)).createOrReplaceTempView("resolved_prompts")
        return spark.sql(f"""
            SELECT rollout_id, prompt_id, json_state, position_found, round({rule}, 6) AS reward_raw
            FROM parsed_rollouts r JOIN resolved_prompts p ON r.prompt_id = p.record_id WHERE category = '{category}'""")
    return q


reward_advantage_sql = _sql_rule(G.ADV, "rule_advantaged_player(json_state, pred_advantage, eval_value, false)")
reward_final_score_sql = _sql_rule(G.FINAL, "rule_final_score(json_state, pred_score, eval_value)")
reward_last_move_sql = _sql_rule(G.LAST, "rule_last_move(json_state, pred_move, best_move, transform(slice(top_moves, 1, 5), m -> m.move))")


def reward_all(spark, sf):
    return flat(_scored(spark, sf).select("rollout_id", "category", "json_state", "reward_raw", "think_tokens",
                                          "penalty", "reward"))


def reward_all_indexed(spark, sf):
    ix = I.index(spark, sf)
    s = G.score_rollouts(I.rollouts(spark, sf), I.prompts(spark, sf), ix.evals, children=ix.children, fens=ix.fens)
    return flat(s.select("rollout_id", "category", "json_state", "reward_raw", "think_tokens", "penalty", "reward"))


def reward_all_stored(spark, sf):
    """The score of stored answers: completions are not read."""
    s = G.score_rollouts(I.answers(spark, sf), I.prompts(spark, sf), I.evals(spark, sf), children=I.children(spark, sf), fens=I.fens(spark, sf))
    return flat(s.select("rollout_id", "category", "json_state", "reward_raw", "think_tokens", "penalty", "reward"))


def reward_all_mate_scaled(spark, sf):
    return flat(_scored(spark, sf, mate="scaled").select("rollout_id", "category", "reward_raw", "reward"))


def reward_weighted(spark, sf):
    w = G.weighted_rewards(_scored(spark, sf), fx.weights(spark))
    return flat(R.weighted_report(w))


# --- REPORT ----------------------------------------------------------------

def group_advantage(spark, sf):
    # as the report job does it: the scored rows feed both the statistics and
    # the join back, and only a written table of statistics lets AQE split a
    # hot group
    scored = materialise(_scored(spark, sf), "scored")
    a = R.group_advantage(scored, stats=materialise(R.group_stats(scored), "group-stats"))
    return flat(a.select("rollout_id", "prompt_id", "reward", "group_mean", "group_std",
                         F.col("group_size").cast("long").alias("group_size"), "advantage"))


def reward_by_interval(spark, sf):
    return flat(R.reward_by_interval(_scored(spark, sf)))


def reward_trend(spark, sf):
    return flat(R.reward_trend(_scored(spark, sf)))


def _sparse_steps(spark, sf):
    """The scored rollouts with steps of growing distance, so that there are
    intervals without rewards."""
    return _scored(spark, sf).withColumn("step", (F.col("step") % 50) * (F.col("step") % 50))


def reward_by_interval_complete(spark, sf):
    return flat(R.reward_by_interval(_sparse_steps(spark, sf), complete=True))


def reward_trend_complete(spark, sf):
    return flat(R.reward_trend(_sparse_steps(spark, sf), complete=True))


def reward_slope(spark, sf):
    return flat(R.reward_slope(_scored(spark, sf)))


def completion_lengths(spark, sf):
    return flat(R.completion_lengths(I.rollouts(spark, sf)))


def length_sketch_quantiles(spark, sf):
    """Quantiles by category from the sketches of every step, and whether the
    exact rank of each is within the sketch's bound."""
    named = I.rollouts(spark, sf).join(I.prompts(spark, sf).select(F.col("record_id").alias("prompt_id"), "category"), "prompt_id", "left")
    named = named.withColumn("category", F.coalesce("category", F.lit("")))
    steps = materialise(SK.length_sketches(named, ["step", "category"]), "length-sketches")
    found = SK.sketch_quantiles(SK.merged_sketches(steps, ["category"]), [0.1, 0.5, 0.9, 0.99])
    chars = F.length(F.coalesce("completion", F.lit("")))
    ranks = found.join(named.groupBy("category", chars.alias("length")).count(), "category").groupBy("category", "n", "p").agg(
        (F.sum(F.when(F.col("length") < F.col("chars"), F.col("count")).otherwise(0)) / F.col("n")).alias("below"),
        (F.sum(F.when(F.col("length") <= F.col("chars"), F.col("count")).otherwise(0)) / F.col("n")).alias("upto"))
    error = SK.rank_error()
    return ranks.select("category", "n", "p", ((F.col("below") - error <= F.col("p")) & (F.col("p") <= F.col("upto") + error)).alias("within_bound"))


def reward_by_category(spark, sf):
    return flat(R.reward_by_category(_scored(spark, sf)))


def completion_sample(spark, sf):
    return R.completion_sample(I.rollouts(spark, sf))


QUERIES = {
    "split_3way_assign": split_3way_assign,
    "split_4way_assign": split_4way_assign,
    "split_4way_unranked": split_4way_unranked,
    "split_size_report": split_size_report,
    "split_size_report_footers": split_size_report_footers,
    "split_resolve": split_resolve,
    "split_resolve_rl": split_resolve_rl,
    "sft_messages": sft_messages,
    "rl_prompts": rl_prompts,
    "rl_prompts_with_answer": rl_prompts_with_answer,
    "conversation_text_chatml": conversation_text_chatml,
    "conversation_text_llama3": conversation_text_llama3,
    "token_rows_masked": token_rows_masked,
    "token_rows_last_header": token_rows_last_header,
    "token_rows_by_turn": token_rows_by_turn,
    "token_audit": token_audit_q,
    "completion_parse": completion_parse,
    "completion_parse_messages": completion_parse_messages,
    "completion_parse_strip_think": completion_parse_strip_think,
    "completion_lists": completion_lists,
    "completion_parse_stored": completion_parse_stored,
    "completion_lists_stored": completion_lists_stored,
    "positions_to_evaluate": positions_to_evaluate,
    "position_lookup": position_lookup,
    "position_lookup_indexed": position_lookup_indexed,
    "evaluation_ledger": evaluation_ledger,
    "reward_next_move": reward_next_move,
    "reward_advantage_sql": reward_advantage_sql,
    "reward_final_score_sql": reward_final_score_sql,
    "reward_last_move_sql": reward_last_move_sql,
    "reward_advantage": reward_advantage,
    "reward_advantage_draw_credit": reward_advantage_draw_credit,
    "reward_final_score": reward_final_score,
    "reward_missing_moves": reward_missing_moves,
    "reward_last_move": reward_last_move,
    "reward_sort_fens": reward_sort_fens,
    "reward_linear": reward_linear,
    "reward_all": reward_all,
    "reward_all_indexed": reward_all_indexed,
    "reward_all_stored": reward_all_stored,
    "reward_all_mate_scaled": reward_all_mate_scaled,
    "reward_weighted": reward_weighted,
    "group_advantage": group_advantage,
    "reward_by_interval": reward_by_interval,
    "reward_trend": reward_trend,
    "reward_by_interval_complete": reward_by_interval_complete,
    "reward_trend_complete": reward_trend_complete,
    "reward_slope": reward_slope,
    "completion_lengths": completion_lengths,
    "length_sketch_quantiles": length_sketch_quantiles,
    "reward_by_category": reward_by_category,
    "completion_sample": completion_sample,
}
