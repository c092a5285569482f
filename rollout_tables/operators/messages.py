"""PREP job: records and conversation turns to messages, prompts and text
(B1-B8, B11).

Records have ``task``, ``KIND``, ``input`` and ``expected_output`` (or
``output``); optional ``messages``, ``moves``, ``FENs``. Which columns exist
is decided once from the schema, as the original code decides by key
presence; everything per row is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollout_tables.fixed_values import (
    RESPOND, RESPOND_FORMAT, RESPONSE_FORMATS, SIDE_TO_MOVE, SIDE_TO_MOVE_KINDS, SYSTEM_KIND, SYSTEM_PREFIX,
    SYSTEM_TASK,
)
from rollout_tables.functions.chat import render_chatml
from rollout_tables.functions.text import variant_as_py_str, variant_type

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def _text(df: DataFrame, name: str) -> Column:
    """A string field with '' for a missing column or a null value."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def _answer(df: DataFrame) -> Column:
    """``expected_output``, else ``output``, else '' - by column presence."""
    for name in ("expected_output", "output"):
        if name in df.columns:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))
    return F.lit("")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _empty_messages() -> Column:
    return F.array().cast(MESSAGES_TYPE)


def _given_messages(df: DataFrame) -> Column | None:
    """``messages`` when the column exists and the row's list is non-empty."""
    if "messages" not in df.columns:
        return None
    m = F.col("messages").cast(MESSAGES_TYPE)
    return F.when(F.size(F.coalesce(m, _empty_messages())) > 0, m)


def _instruction(kind: Column, with_side: bool, side: Column | None = None) -> Column:
    """The format instruction appended to the user turn."""
    chain = None
    for k, fmt in RESPONSE_FORMATS.items():
        if with_side and k in SIDE_TO_MOVE_KINDS:
            text = F.concat(F.lit("\n\n" + SIDE_TO_MOVE), side, F.lit("\n\n" + RESPOND_FORMAT + fmt))
        else:
            text = F.lit(" " + RESPOND_FORMAT + fmt)
        chain = F.when(kind == k, text) if chain is None else chain.when(kind == k, text)
    return chain.otherwise(F.lit(" " + RESPOND))


def sft_messages(records: DataFrame) -> DataFrame:
    """B1 + B8 + B9: the SFT conversation and its rendered text; all source
    columns are kept, as the first preparation step keeps them."""
    task, kind, inp, out = _text(records, "task"), _text(records, "KIND"), _text(records, "input"), _answer(records)
    system = F.concat(F.lit(SYSTEM_PREFIX + SYSTEM_TASK), task, F.lit(SYSTEM_KIND), kind)
    built = F.when(inp != "", F.array(_message("system", system), _message("user", inp),
                                      _message("assistant", out))).otherwise(_empty_messages())
    given = _given_messages(records)
    messages = built if given is None else F.coalesce(given, built)
    out_df = records.withColumn("messages", messages)
    return out_df.withColumn("text", render_chatml(F.col("messages")))


def with_prompt_inputs(records: DataFrame) -> DataFrame:
    """Adds ``moves`` and ``fens`` from the JSON ``input``, falling back to
    the top-level ``moves`` / ``FENs`` columns when it does not parse, exactly
    where the original code falls back (decode or type error). Existing
    ``moves`` / ``FENs`` columns are replaced."""
    empty = F.array().cast("array<string>")
    top_moves = F.coalesce(F.col("moves").cast("array<string>"), empty) if "moves" in records.columns else empty
    top_fens = F.coalesce(F.col("FENs").cast("array<string>"), empty) if "FENs" in records.columns else empty
    inp = _text(records, "input")
    df = records.withColumns({"_top_moves": top_moves, "_top_fens": top_fens,
                              "_objs": F.from_json(F.concat(F.lit("["), inp, F.lit("]")), "ARRAY<MAP<STRING,VARIANT>>",
                                                   {"allowSingleQuotes": "false"})})
    # as the only item of an array an object can have nothing after it
    df = df.withColumn("_obj", F.when(F.size("_objs") == 1, F.col("_objs")[0])).drop("_objs")
    obj, v = F.col("_obj"), F.col("_var")
    # what else the text may be matters only where it is no object
    df = df.withColumn("_var", F.when(obj.isNull(), F.try_parse_json(inp)))
    # exact (case-sensitive) keys; a repeated key reads its last value
    entries = F.map_entries(obj)
    df = df.withColumns({
        "_t": variant_type(v),
        "_has_moves": F.array_contains(F.map_keys(obj), "moves"),
        "_has_fen": F.array_contains(F.map_keys(obj), "FEN"),
        "_moves_val": F.try_element_at(F.filter(entries, lambda e: e["key"] == "moves"), F.lit(-1))["value"],
        "_fen_val": F.try_element_at(F.filter(entries, lambda e: e["key"] == "FEN"), F.lit(-1))["value"],
        "_str_val": F.try_variant_get(v, "$", "string"),
        "_arr_val": F.try_variant_get(v, "$", "array<string>"),
    })
    t = F.col("_t")
    obj_moves = F.when(F.col("_has_moves"), F.coalesce(F.try_variant_get(F.col("_moves_val"), "$", "array<string>"),
                                                       empty)).otherwise(empty)
    fen_val = F.when(variant_type(F.col("_fen_val")) != "VOID", variant_as_py_str(F.col("_fen_val")))
    obj_fens = F.when(F.col("_has_fen"), F.array(fen_val)).otherwise(empty)
    # a JSON string or array answers `"moves" in x` by membership, then fails
    # on x["moves"]; numbers, booleans and null fail at once
    sv, av = F.col("_str_val"), F.col("_arr_val")
    str_fails = (F.instr(sv, "moves") > 0) | (F.instr(sv, "FEN") > 0)
    arr_fails = F.coalesce(F.array_contains(av, "moves") | F.array_contains(av, "FEN"), F.lit(False))
    falls_back = ((v.isNull() & obj.isNull()) | ((t == "STRING") & str_fails) | (t.startswith("ARRAY") & arr_fails)
                  | (obj.isNull() & t.startswith("OBJECT"))
                  | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "BOOLEAN", "VOID")
                  | t.startswith("DECIMAL"))
    df = df.withColumn("_falls_back", falls_back)
    fb = F.col("_falls_back")
    df = df.withColumns({
        "moves": F.when(obj.isNotNull(), obj_moves).when(fb, F.col("_top_moves")).otherwise(empty),
        "fens": F.when(obj.isNotNull(), obj_fens).when(fb, F.col("_top_fens")).otherwise(empty),
    })
    return df.drop("_top_moves", "_top_fens", "_obj", "_var", "_t", "_has_moves", "_has_fen", "_moves_val",
                   "_fen_val", "_str_val", "_arr_val", "_falls_back")


def rl_prompts(records: DataFrame) -> DataFrame:
    """The RL prompt (system + user, no answer), category, moves and
    fens. ``record_id`` is kept when present so rollouts can join back."""
    task, kind, inp = _text(records, "task"), _text(records, "KIND"), _text(records, "input")
    keep = [c for c in ("record_id",) if c in records.columns]
    df = with_prompt_inputs(records).select(*keep, task.alias("_task"), kind.alias("_kind"), inp.alias("_input"),
                                            "moves", "fens")
    task, kind, inp = F.col("_task"), F.col("_kind"), F.col("_input")
    side = F.when(F.size("moves") % 2 == 0, F.lit("White")).otherwise(F.lit("Black"))
    system = F.concat(F.lit(SYSTEM_PREFIX),
                      F.when(task != "", F.concat(F.lit(SYSTEM_TASK), task)).otherwise(F.lit("")),
                      F.when(kind != "", F.concat(F.lit(SYSTEM_KIND), kind)).otherwise(F.lit("")))
    user = F.when(kind != "", F.concat(inp, _instruction(kind, True, side))).otherwise(inp)
    prompt = F.when((task != "") | (inp != ""), F.array(_message("system", system), _message("user", user))) \
        .otherwise(_empty_messages())
    return df.select(*keep, prompt.alias("prompt"), kind.alias("category"), "moves", "fens")


def rl_prompts_with_answer(records: DataFrame) -> DataFrame:
    """The RL-side template variant: full system text, the format
    instruction after one space (the default one even for an empty kind), the
    answer turn, rendered with the generation header."""
    task, kind, inp, out = _text(records, "task"), _text(records, "KIND"), _text(records, "input"), _answer(records)
    system = F.concat(F.lit(SYSTEM_PREFIX + SYSTEM_TASK), task, F.lit(SYSTEM_KIND), kind)
    user = F.concat(inp, _instruction(kind, False))
    built = F.when(inp != "", F.array(_message("system", system), _message("user", user),
                                      _message("assistant", out))).otherwise(_empty_messages())
    given = _given_messages(records)
    messages = built if given is None else F.coalesce(given, built)
    keep = [c for c in ("record_id",) if c in records.columns]
    return records.select(*keep, messages.alias("messages")).withColumn("text", render_chatml(F.col("messages")))


def conversation_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One message array per conversation from (conv_id, turn, role,
    text) rows, in turn order. One output row is one conversation, so its
    size is that of the conversation (bounded by the model context it is
    prepared for)."""
    packed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return (turns.groupBy(key).agg(packed.alias("_turns"))
            .select(key, F.transform("_turns", lambda t: F.struct(t["role"].alias("role"),
                                                                  t["text"].alias("content"))).alias("messages")))
