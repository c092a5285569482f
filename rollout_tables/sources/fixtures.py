"""Derived views of the driver tables (see FIXTURES.md).

The project's own inputs (instruction records, rollouts, position
evaluations, token rows) are not shipped; these views derive them from the
TPC-H-like tables with expressions that give the same values in Spark and
in the SQL oracle. All of them are narrow projections of one scan except
``evals``, which is a distinct over the positions the records reach.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.fixed_values import CATEGORIES, CATEGORY_WEIGHTS, START_FEN

# Test-data parameters of our own (not values of the original project).
OTHER_KIND = "OTHER"
KINDS = CATEGORIES + [OTHER_KIND]
OPENING = ["e2e4", "e7e5", "g1f3", "b8c6", "f1b5", "a7a6", "b5a4", "g8f6", "e1g1", "f8e7", "f1e1", "b7b5"]
ADVANTAGE_WORDS = ["White", "black", "draw"]
SCORE_WORDS = ["1-0", "0-1", "1/2-1/2"]
ANSWER_KEYS = {
    "FIND_NEXT_BEST_MOVE": "next best move",
    "FIND_ADVANTAGED_PLAYER": "Most advantaged",
    "FIND_FINAL_SCORE": "score",
    "MLM_ON_MOVES": "missing moves",
    "FIND_LAST_MOVE": "missing move",
    "SORT_FENS": "sorted FENs",
    OTHER_KIND: "answer",
}
ROLE_CODES = {"system": 1, "user": 2, "assistant": 3}
MESSAGE_END_ID = 248046
PAD_ID = 248044
TOKEN_ROW_LENGTH = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _pick(values, idx: Column) -> Column:
    """``values[idx]`` for a small fixed list (0-based)."""
    return F.get(F.array(*[F.lit(v) for v in values]), idx.cast("int"))


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def fen_of(key: Column) -> Column:
    """FEN-like text of a position key: the start FEN for '', else the key
    with the side to move by move-count parity."""
    n = F.size(F.split(key, " ", -1))
    side = F.when(n % 2 == 0, F.lit(" w - 0")).otherwise(F.lit(" b - 0"))
    return F.when(key == "", F.lit(START_FEN)).otherwise(F.concat(key, side))


def _prefix(n: Column) -> Column:
    return F.slice(F.array(*[F.lit(m) for m in OPENING]), 1, n.cast("int"))


def _spread(df: DataFrame, parts: int | None) -> DataFrame:
    """The narrow source rows dealt over ``parts`` tasks: the driver tables are
    single files of few row groups, each of which one task reads, and the
    derived rows are several times wider."""
    return df if parts is None else df.repartition(parts, *df.columns)


def records(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Instruction records, one per order."""
    o = _spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), parts)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s1 = o.select(
        k.alias("record_id"), F.col("o_orderpriority").alias("task"), _pick(KINDS, k % 7).alias("KIND"),
        (F.floor(k / 7) % 13).alias("_n_open"),
        F.concat(F.char(F.lit(97) + c % 8), (F.lit(1) + F.floor(c / 8) % 8).cast("string"),
                 F.char(F.lit(97) + F.floor(c / 64) % 8), (F.lit(1) + F.floor(c / 512) % 8).cast("string")
                 ).alias("_pseudo"))
    s2 = s1.withColumn("moves", _prefix(F.col("_n_open")))
    played = F.concat(F.col("moves"), F.array(F.col("_pseudo")))
    # masked-move records carry a '?' placeholder in place of the second move
    s3 = s2.withColumn("_played", F.when(
        (F.col("KIND") == "MLM_ON_MOVES") & (F.col("_n_open") >= 2),
        F.transform(played, lambda m, i: F.when(i == 1, F.lit("?")).otherwise(m))).otherwise(played))
    s4 = s3.withColumns({"_played_key": F.array_join("_played", " "), "_prefix_key": F.array_join("moves", " ")})
    as_json = F.concat(F.lit('{"moves": ['), F.array_join(F.transform("_played", _quote), ", "),
                       F.lit('], "FEN": "'), fen_of(F.col("_played_key")), F.lit('"}'))
    plain = F.concat(F.lit("Moves played: "), F.col("_played_key"))
    inp = F.when(F.col("record_id") % 97 == 0, F.lit("")).when(F.col("record_id") % 11 == 0, plain).otherwise(as_json)
    return s4.select(
        "record_id", "task", "KIND",
        inp.alias("input"),
        F.concat(F.lit('{"move": "'), F.col("_pseudo"), F.lit('"}')).alias("expected_output"),
        "moves",
        F.array(fen_of(F.col("_prefix_key"))).alias("FENs"),
    )


def rollouts(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Rollouts, one per line item (a few with a prompt that does not exist,
    or none): ``prompt_id`` is the order, so groups have
    1 to 17 completions. The completion shape cycles through the parse cases
    by ``l_partkey % 10``."""
    li = _spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), parts)
    okey, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    rollout_id = F.concat_ws("-", okey.cast("string"), F.col("l_linenumber").cast("string"),
                             part.cast("string"), supp.cast("string"),
                             F.round(F.col("l_quantity") * 100).cast("bigint").cast("string"),
                             F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    s1 = li.select(rollout_id.alias("rollout_id"), F.when(part % 97 == 0, -okey).when(part % 97 != 1, okey).alias("prompt_id"), (okey % 2000).alias("step"),
                   _pick(KINDS, okey % 7).alias("_kind"), _pick([ANSWER_KEYS[k] for k in KINDS], okey % 7).alias("_key"),
                   (supp + F.floor(part / 10)).alias("_h"), (part % 10).alias("_n"))
    h, kind, key = F.col("_h"), F.col("_kind"), F.col("_key")
    s2 = s1.withColumns({
        "_mv": _pick(OPENING, h % 12), "_mv2": _pick(OPENING, F.floor(h / 12) % 12),
        "_f0": fen_of(F.array_join(_prefix(h % 13), " ")),
        "_f1": fen_of(F.array_join(_prefix(F.floor(h / 13) % 13), " ")),
        "_f2": fen_of(F.array_join(_prefix(F.floor(h / 169) % 13), " ")),
    })
    mv, mv2 = F.col("_mv"), F.col("_mv2")
    fens = [F.col("_f0"), F.col("_f1"), F.col("_f2")]
    fen_list = F.concat(F.lit("["), F.concat_ws(", ", *[_quote(f) for f in fens]), F.lit("]"))
    value = (F.when(kind == "FIND_ADVANTAGED_PLAYER", _quote(_pick(ADVANTAGE_WORDS, h % 3)))
             .when(kind == "FIND_FINAL_SCORE", _quote(_pick(SCORE_WORDS, h % 3)))
             .when(kind == "MLM_ON_MOVES", F.concat(F.lit("["), _quote(mv), F.lit(", "), _quote(mv2), F.lit("]")))
             .when(kind == "SORT_FENS", fen_list)
             .otherwise(_quote(mv)))
    s3 = s2.withColumn("_value", value)
    s4 = s3.withColumn("_obj", F.concat(F.lit('{"'), key, F.lit('": '), F.col("_value"), F.lit("}")))
    obj, n = F.col("_obj"), F.col("_n")
    prose = F.when(kind == "FIND_FINAL_SCORE", F.concat(F.lit(" "), _pick(SCORE_WORDS, h % 3), F.lit(" "))).otherwise(
        F.concat(F.lit("I think "), mv, F.lit(" is strong"),
                 _pick([" for white.", " for white, not black.", ", it is a draw."], h % 3)))
    filler = F.when(h % 2 == 0, F.repeat(F.lit("a"), 1200)).otherwise(F.repeat(F.lit("a"), 4000))
    listy = (F.when(kind == "SORT_FENS", F.concat(F.lit('{"sorted FENs": ['), _quote(fens[0]), F.lit(", "),
                                                   _quote(F.concat(F.lit("x"), fens[1])), F.lit(", "),
                                                   _quote(fens[2]), F.lit("]}")))
             .when(h % 2 == 0, F.concat(F.lit('{"missing moves": ['), _quote(mv), F.lit(", "), _quote(mv),
                                        F.lit(', "?"]}')))
             .otherwise(F.concat(F.lit('{"missing moves": "['), mv, F.lit(", "), mv2, F.lit(', ?]"}'))))
    completion = (F.when(n == 0, obj)
                  .when(n == 1, F.replace(obj, F.lit('"'), F.lit("'")))
                  .when(n == 2, F.concat(F.lit('{"'), F.upper(key), F.lit('": '), F.col("_value"), F.lit("}")))
                  .when(n == 3, prose)
                  .when(n == 4, F.concat(F.lit("<|im_start|>assistant\n<think>\n"), filler,
                                         F.lit("\n</think>\n"), obj))
                  .when(n == 5, F.concat(F.lit('{"answer": '), obj, F.lit("}")))
                  .when(n == 6, F.when(h % 2 == 0, F.lit('"1-0"')).otherwise(F.lit("[1]")))
                  .when(n == 7, F.concat(F.lit('{"note": "'), mv, F.lit('"}')))
                  .when(n == 8, listy)
                  .otherwise(F.lit("")))
    return s4.select("rollout_id", "prompt_id", "step", completion.alias("completion"))


def opening_positions(spark: SparkSession) -> DataFrame:
    """The 13 positions along the opening line (start included); the SORT_FENS
    answers list their FENs."""
    return spark.range(len(OPENING) + 1).select(F.array_join(_prefix(F.col("id")), " ").alias("position_key"))


def evals(spark: SparkSession, sf_dir: str, prompts: DataFrame | None = None) -> DataFrame:
    """Position evaluations: every position a prompt reaches, the opening
    line, and the positions after about two thirds of the pool moves from
    each of them. Keys whose md5 starts with 'f' are left out (so the
    start-position fallback is exercised), and so are keys with a '?'
    placeholder, which are not positions."""
    from rollout_tables.operators.messages import rl_prompts
    if prompts is None:
        prompts = rl_prompts(records(spark, sf_dir))
    # each position once before its successors are made of it
    base = (prompts.select(F.array_join("moves", " ").alias("position_key"))
            .unionByName(opening_positions(spark))).distinct()
    pool = F.array(*[F.lit(m) for m in OPENING])
    children = base.select(F.explode(F.transform(
        pool, lambda m: F.concat_ws(" ", F.nullif(F.col("position_key"), F.lit("")), m))).alias("position_key"))
    children = children.filter(F.conv(F.substring(F.md5("position_key"), 2, 1), 16, 10).cast("int") % 3 != 0)
    keys = base.unionByName(children).distinct().withColumn("_md5", F.md5("position_key"))
    keys = keys.filter(((F.col("position_key") == "") | ~F.col("_md5").startswith("f"))
                       & ~F.col("position_key").contains("?"))
    return with_evaluation(keys)


def with_evaluation(keys: DataFrame) -> DataFrame:
    """Deterministic evaluation columns from the md5 of ``position_key``."""
    if "_md5" not in keys.columns:
        keys = keys.withColumn("_md5", F.md5("position_key"))
    h = F.col("_md5")

    def hexdigit(i):
        return F.conv(F.substring(h, i, 1), 16, 10).cast("int")

    keys = keys.withColumn("_value", (F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % 1601 - 800).cast("int"))
    value = F.col("_value")
    top = F.array(*[F.struct(_pick(OPENING, hexdigit(5 + i) % 12).alias("move"),
                             (value - 15 * i).cast("int").alias("score"),
                             F.lit(None).cast("int").alias("mate"),
                             F.lit(15).alias("depth")) for i in range(5)])
    return keys.select(
        "position_key",
        fen_of(F.col("position_key")).alias("fen"),
        F.when(F.substring(h, 32, 1) == "0", F.lit("mate")).otherwise(F.lit("cp")).alias("eval_type"),
        value.alias("eval_value"),
        _pick(OPENING, hexdigit(5) % 12).alias("best_move"),
        top.alias("top_moves"),
    )


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays per conversation: each message is ``[248045, role, 198]``,
    the word lengths of its text, and an end marker; even conversations end
    with an empty assistant header, as a generation prompt does."""
    from rollout_tables.operators.messages import conversation_messages
    conv = conversation_messages(table(spark, sf_dir, "conversations"))
    codes = F.create_map(*[x for r, code in ROLE_CODES.items() for x in (F.lit(r), F.lit(code))])

    def msg_ids(m):
        words = F.transform(F.split(F.coalesce(m["content"], F.lit("")), " ", -1), lambda w: F.length(w))
        return F.concat(F.array(F.lit(248045), F.coalesce(F.try_element_at(codes, m["role"]), F.lit(0)), F.lit(198)),
                        words, F.array(F.lit(MESSAGE_END_ID)))

    ids = F.flatten(F.transform("messages", msg_ids))
    ids = F.when(F.col("conv_id") % 2 == 0, F.concat(ids, F.array(F.lit(248045), F.lit(3), F.lit(198)))).otherwise(ids)
    return conv.select("conv_id", ids.cast("array<int>").alias("input_ids"))


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token rows turn by turn: (conv_id, turn, ids), with the closing
    empty header of even conversations as a turn after the last one."""
    turns = table(spark, sf_dir, "conversations")
    codes = F.create_map(*[x for r, code in ROLE_CODES.items() for x in (F.lit(r), F.lit(code))])
    words = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), " ", -1), lambda w: F.length(w))
    ids = F.concat(F.array(F.lit(248045), F.coalesce(F.try_element_at(codes, F.col("role")), F.lit(0)), F.lit(198)),
                   words, F.array(F.lit(MESSAGE_END_ID)))
    closing = turns.filter(F.col("conv_id") % 2 == 0).select("conv_id").distinct().select(
        "conv_id", F.lit((1 << 62)).alias("turn"), F.array(F.lit(248045), F.lit(3), F.lit(198)).alias("ids"))
    return turns.select("conv_id", "turn", ids.cast("array<int>").alias("ids")).unionByName(closing)


def weights(spark: SparkSession) -> DataFrame:
    """The declared category weights (six rows)."""
    return spark.createDataFrame(CATEGORY_WEIGHTS, "category string, weight double")
