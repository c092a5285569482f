"""Command-line entry points, one per job, for ``spark-submit``:

    python -m rollout_tables.jobs split    --input records --output splits [--with-validation] [--seed 42]
    python -m rollout_tables.jobs prep-sft --input splits --split sft_train --output sft_text
    python -m rollout_tables.jobs prep-rl  --input splits --split rl --output prompts
    python -m rollout_tables.jobs tokens   --input token_rows --output masked --max-len 2048 --pad-id 0
    python -m rollout_tables.jobs index    --evals e --output index [--mate scaled] [--buckets 2000]
    python -m rollout_tables.jobs worklist --rollouts r --prompts p --evals e --output positions
    python -m rollout_tables.jobs parse    --rollouts r --output answers [--strip-think]
    python -m rollout_tables.jobs score    --rollouts r --prompts p (--evals e | --index index) --output rewards
    python -m rollout_tables.jobs report   --rewards rewards --output reports
    python -m rollout_tables.jobs completions --rollouts r --output reports

Inputs and outputs are tables in any Spark source format (parquet by
default). Each job reads, transforms and writes; nothing is collected.
"""

from __future__ import annotations

import argparse
import os


from rollout_tables.fixed_values import SPLIT_SEED, SPLITS_3WAY, SPLITS_4WAY
from rollout_tables.operators import messages as M
from rollout_tables.operators import reports as R
from rollout_tables.operators import splits as S
from rollout_tables.operators import tokens as T
from rollout_tables.operators.evals import fen_values, position_children, positions_to_evaluate, scored_evals
from rollout_tables.operators.index import open_index, write_index
from rollout_tables.operators.objects import stored_answers
from rollout_tables.operators.rewards import score_rollouts
from rollout_tables.session import build_session, materialise
from rollout_tables.sources import datasets as DS
from rollout_tables.sources.footers import footer_counts


def _read(spark, path, fmt):
    return spark.read.format(fmt).load(path)


def split(spark, a):
    """SPLIT: exact-size seeded splits, written partitioned by split (A6),
    and the size report (D6) beside them."""
    df = DS.read_dataset(spark, a.input, a.format)
    ratios = SPLITS_4WAY if a.with_validation else SPLITS_3WAY
    if "record_id" not in df.columns:
        raise SystemExit("the input needs a record_id column to order the split by")
    assigned = S.assign_splits(df.drop("split") if "split" in df.columns else df, "record_id", ratios, a.seed, with_rank=False)
    DS.write_splits(assigned, a.output)
    S.size_report_of(footer_counts(spark, a.output, ["split"]), ratios).write.mode("overwrite").parquet(a.output + "_report")


def prep_sft(spark, a):
    """PREP (SFT): messages and rendered text for the requested split."""
    df = _read(spark, a.input, a.format)
    df = DS.sft_train_split(df, a.split, known=DS.split_names(df)) if a.split else df
    M.sft_messages(df).write.mode("overwrite").parquet(a.output)


def prep_rl(spark, a):
    """PREP (RL): prompt, category, moves and fens for the requested split."""
    df = _read(spark, a.input, a.format)
    if a.split:
        df, _ = DS.rl_train_split(df, a.split, known=DS.split_names(df))
    M.rl_prompts(df).write.mode("overwrite").parquet(a.output)


def tokens(spark, a):
    """Token rows (C1-C4), and their audit (C5) beside them."""
    masked = T.mask_token_rows(_read(spark, a.input, a.format), a.max_len, a.pad_id, a.rule)
    masked.write.mode("overwrite").parquet(a.output)
    T.token_audit(_read(spark, a.output, "parquet"), a.max_len).write.mode("overwrite").parquet(a.output + "_audit")


def index(spark, a):
    """The evaluations as bucketed tables, for later score jobs."""
    write_index(_read(spark, a.evals, a.format), a.output, a.mate, a.buckets)


def worklist(spark, a):
    """the positions and FENs that the rollouts need and the evaluations lack."""
    positions_to_evaluate(_read(spark, a.prompts, a.format), _read(spark, a.rollouts, a.format),
                          _read(spark, a.evals, a.format)).write.mode("overwrite").parquet(a.output)


def completions(spark, a):
    """Lengths of the completions, and a sample of each step."""
    rollouts = _read(spark, a.rollouts, a.format)
    R.completion_lengths(rollouts).write.mode("overwrite").parquet(os.path.join(a.output, "lengths"))
    R.completion_sample(rollouts).write.mode("overwrite").parquet(os.path.join(a.output, "sample"))


def parse(spark, a):
    """PARSE: the answers as shredded variants, which score takes as rollouts."""
    stored_answers(_read(spark, a.rollouts, a.format), strip_think=a.strip_think).write.mode("overwrite").parquet(a.output)


def score(spark, a):
    """REWARD: one reward per rollout. Without an index the lookup tables are
    written first, so that the joins read scans and AQE can split a hot
    position."""
    if a.index:
        ix = open_index(spark, a.index)
        out = score_rollouts(_read(spark, a.rollouts, a.format), _read(spark, a.prompts, a.format), ix.evals,
                             scaling=a.scaling, children=ix.children, fens=ix.fens, strip_think=a.strip_think)
        out.write.mode("overwrite").parquet(a.output)
        return
    evals = _read(spark, a.evals, a.format)
    as_scored = scored_evals(evals, a.mate)
    children = materialise(position_children(as_scored), "children")
    fens = materialise(fen_values(as_scored), "fens")
    out = score_rollouts(_read(spark, a.rollouts, a.format), _read(spark, a.prompts, a.format), evals,
                         scaling=a.scaling, mate=a.mate, children=children, fens=fens, strip_think=a.strip_think)
    out.write.mode("overwrite").parquet(a.output)


def report(spark, a):
    """REPORT: advantages and the metric tables, each its own folder."""
    scored = _read(spark, a.rewards, a.format)
    stats = os.path.join(a.output, "group_stats")
    R.group_stats(scored).write.mode("overwrite").parquet(stats)
    R.group_advantage(scored, stats=_read(spark, stats, "parquet")).write.mode("overwrite").parquet(os.path.join(a.output, "advantages"))
    R.reward_by_category(scored).write.mode("overwrite").parquet(os.path.join(a.output, "by_category"))
    R.reward_by_interval(scored).write.mode("overwrite").parquet(os.path.join(a.output, "by_interval"))
    R.reward_trend(scored).write.mode("overwrite").parquet(os.path.join(a.output, "trend"))


def main(argv=None):
    p = argparse.ArgumentParser(prog="rollout_tables.jobs")
    p.add_argument("--format", default="parquet")
    sub = p.add_subparsers(dest="job", required=True)
    s = sub.add_parser("split")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--with-validation", action="store_true")
    s.add_argument("--seed", type=int, default=SPLIT_SEED)
    for name in ("prep-sft", "prep-rl"):
        q = sub.add_parser(name)
        q.add_argument("--input", required=True)
        q.add_argument("--output", required=True)
        q.add_argument("--split", default=None)
    k = sub.add_parser("tokens")
    k.add_argument("--input", required=True)
    k.add_argument("--output", required=True)
    k.add_argument("--max-len", type=int, required=True)
    k.add_argument("--pad-id", type=int, required=True)
    k.add_argument("--rule", default="answer", choices=["answer", "last_header"])
    x = sub.add_parser("index")
    x.add_argument("--evals", required=True)
    x.add_argument("--output", required=True)
    x.add_argument("--mate", default="as_cp", choices=["as_cp", "scaled"])
    x.add_argument("--buckets", type=int, default=None)
    w = sub.add_parser("worklist")
    for arg in ("--rollouts", "--prompts", "--evals", "--output"):
        w.add_argument(arg, required=True)
    c = sub.add_parser("completions")
    for arg in ("--rollouts", "--output"):
        c.add_argument(arg, required=True)
    o = sub.add_parser("parse")
    for arg in ("--rollouts", "--output"):
        o.add_argument(arg, required=True)
    o.add_argument("--strip-think", action="store_true")
    r = sub.add_parser("score")
    for arg in ("--rollouts", "--prompts", "--output"):
        r.add_argument(arg, required=True)
    given = r.add_mutually_exclusive_group(required=True)
    given.add_argument("--evals")
    given.add_argument("--index", help="written by the index job, which also fixes --mate")
    r.add_argument("--strip-think", action="store_true")
    r.add_argument("--scaling", default="tanh", choices=["tanh", "linear"])
    r.add_argument("--mate", default="as_cp", choices=["as_cp", "scaled"])
    t = sub.add_parser("report")
    t.add_argument("--rewards", required=True)
    t.add_argument("--output", required=True)
    a = p.parse_args(argv)
    spark = build_session()
    {"split": split, "prep-sft": prep_sft, "prep-rl": prep_rl, "tokens": tokens, "index": index, "worklist": worklist,
     "parse": parse, "score": score, "report": report, "completions": completions}[a.job](spark, a)


if __name__ == "__main__":
    main()
