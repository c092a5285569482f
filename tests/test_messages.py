"""Prompts, fallbacks and rendering."""

from pyspark.sql import functions as F

from rollout_tables.functions.chat import render_chatml, render_llama3
from rollout_tables.operators.messages import conversation_messages, rl_prompts, rl_prompts_with_answer, \
    sft_messages

REC = "record_id long, task string, KIND string, input string, expected_output string, moves array<string>, " \
      "FENs array<string>"


def _records(spark, rows):
    return spark.createDataFrame(rows, REC)


def test_rl_prompt_text(spark):
    rows = [(1, "T", "FIND_LAST_MOVE", '{"moves": ["e2e4"], "FEN": "F1"}', "o", ["x", "y"], ["F0"])]
    p = rl_prompts(_records(spark, rows)).collect()[0]
    assert p["category"] == "FIND_LAST_MOVE" and p["moves"] == ["e2e4"] and p["fens"] == ["F1"]
    system, user = p["prompt"]
    assert system["content"] == ("You are an expert chess assistant. Your task is: T\n\n"
                                 "The move classification is: FIND_LAST_MOVE")
    assert user["content"] == ('{"moves": ["e2e4"], "FEN": "F1"}\n\nSide to move: Black\n\n'
                               'Respond in a json in the format {"missing move": "<move>"}')


def test_rl_prompt_variants(spark):
    rows = [
        (1, "", "", "", "", [], []),                          # nothing -> no prompt
        (2, "", "SORT_FENS", "in", "", [], []),               # no task part, one-space instruction
        (3, "T", "NEW_KIND", "in", "", [], []),               # default instruction
        (4, "T", "", "in", "", [], []),                       # no kind -> no instruction
        (5, "T", "FIND_NEXT_BEST_MOVE", "plain text", "", ["a", "b"], ["F"]),   # fallback to columns
        (6, "T", "FIND_NEXT_BEST_MOVE", '["x"]', "", ["a"], ["F"]),             # array: [] and no fallback
        (7, "T", "FIND_NEXT_BEST_MOVE", "5", "", ["a"], ["F"]),                 # number: fallback
        (8, "T", "FIND_NEXT_BEST_MOVE", '{"FEN": "G"}', "", ["a"], ["F"]),     # object without moves
    ]
    got = {r["record_id"]: r for r in rl_prompts(_records(spark, rows)).collect()}
    assert got[1]["prompt"] == []
    assert got[2]["prompt"][0]["content"] == "You are an expert chess assistant.\n\nThe move classification is: SORT_FENS"
    assert got[2]["prompt"][1]["content"].startswith("in Respond in a json in the format {\"sorted FENs\"")
    assert got[3]["prompt"][1]["content"] == "in Respond in a json"
    assert got[4]["prompt"][1]["content"] == "in"
    assert (got[5]["moves"], got[5]["fens"]) == (["a", "b"], ["F"])
    assert "Side to move: White" in got[5]["prompt"][1]["content"]
    assert (got[6]["moves"], got[6]["fens"]) == ([], [])
    assert (got[7]["moves"], got[7]["fens"]) == (["a"], ["F"])
    assert (got[8]["moves"], got[8]["fens"]) == ([], ["G"])


def test_sft_messages_and_text(spark):
    rows = [(1, "T", "K", "in", "out", [], []), (2, "T", "K", "", "out", [], [])]
    got = {r["record_id"]: r for r in sft_messages(_records(spark, rows)).collect()}
    assert [m["role"] for m in got[1]["messages"]] == ["system", "user", "assistant"]
    assert got[1]["text"].endswith("<|im_start|>assistant\nout<|im_end|>\n<|im_start|>assistant\n")
    assert got[2]["messages"] == [] and got[2]["text"] == "<|im_start|>assistant\n"
    assert "task" in sft_messages(_records(spark, rows)).columns  # source columns kept


def test_given_messages_win(spark):
    df = spark.createDataFrame([(1, "in", [("user", "hi")]), (2, "in", [])],
                               "record_id long, input string, messages array<struct<role:string,content:string>>")
    got = {r["record_id"]: r["messages"] for r in sft_messages(df).collect()}
    assert [m["content"] for m in got[1]] == ["hi"]
    assert len(got[2]) == 3  # empty list: built from the fields, with '' for missing ones


def test_with_answer_variant(spark):
    rows = [(1, "T", "", "in", "out", [], [])]
    r = rl_prompts_with_answer(_records(spark, rows)).collect()[0]
    assert r["messages"][1]["content"] == "in Respond in a json"
    assert r["messages"][2]["content"] == "out"


def test_conversations_and_llama3(spark):
    turns = spark.createDataFrame([(1, 1, "user", " hi "), (1, 0, "system", " sys "), (1, 2, "assistant", "yo")],
                                  "conv_id long, turn long, role string, text string")
    conv = conversation_messages(turns)
    text = conv.select(render_llama3(F.col("messages")).alias("t")).collect()[0]["t"]
    assert text == ("<|start_header_id|>system<|end_header_id|>\n\n sys <|eot_id|>\n"
                    "<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|>\n"
                    "<|start_header_id|>assistant<|end_header_id|>\n\nyo<|eot_id|>\n"
                    "<|start_header_id|>assistant<|end_header_id|>\n\n")
    chat = conv.select(render_chatml(F.col("messages"), add_generation_prompt=False).alias("t")).collect()[0]["t"]
    assert chat.startswith("<|im_start|>system\n sys <|im_end|>\n<|im_start|>user\n hi <|im_end|>\n")
