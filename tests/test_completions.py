"""Parse outcomes for hand-written completions."""

import pytest

from rollout_tables.operators.parse import parse_completions

THINK = "<|im_start|>assistant\n<think>\n"

CASES = [
    # completion, state, move, advantage, score
    ('{"a": {"Next Best Move": " e2e4 "}}', "object", "e2e4", "", ""),
    ("{'move': 'e2e4'}", "object", "e2e4", "", ""),
    ('{"move": null}', "object", "None", "", ""),
    ('{"move": "x", "move": "e2e4"}', "object", "e2e4", "", ""),
    ('{"Move": "a", "next best move": "b"}', "object", "b", "", ""),
    ('{"best move": "c2c4", "missing move": "d2d4"}', "object", "d2d4", "", ""),
    ('{"note": "g1f3"}', "object", "g1f3", "", ""),
    ("play g1f3 now, white wins", "text", "g1f3", "white", "play g1f3 now, white wins"),
    ('"1-0"', "non_object", "", "", ""),
    ("[1]", "non_object", "", "", ""),
    ("5", "non_object", "", "", ""),
    ("1 0", "text", "", "", "1 0"),
    ("", "text", "", "", ""),
    (" '1/2-1/2' ", "non_object", "", "", ""),
    (" 1/2-1/2 ", "text", "", "", "1/2-1/2"),
    ("White or Black? black", "text", "", "white", "white or black? black"),
    ("it is a Draw", "text", "", "draw", "it is a draw"),
    ('{"Most Advantaged": " Black "}', "object", "", "black", ""),
    ('{"final SCORE": "0-1"}', "object", "", "", "0-1"),
    ('{"most advantaged": true}', "object", "", "true", ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(str(i), 1, 0, c) for i, (c, *_) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "rollout_id string, prompt_id long, step long, completion string")
    return {r["rollout_id"]: r for r in parse_completions(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_parse_labels(parsed, i):
    c, state, move, adv, score = CASES[i]
    r = parsed[str(i)]
    assert r["json_state"] == state, c
    if state != "non_object":
        assert r["pred_move"] == move, c
    assert r["pred_advantage"] == adv, c
    if state == "text" or score:
        assert r["pred_score"] == score.lower(), c


LISTS = [
    ('{"missing moves": ["e7e5", "e7e5", "?"]}', ["e7e5", "e7e5", "?"], None),
    ('{"missing moves": "[e7e5, c7c5, ?]"}', ["e7e5", "c7c5"], None),
    ('{"Missing Moves": " e7e5 , , ?"}', ["e7e5"], None),
    ('{"missing moves": 5}', None, None),
    ('{"missing moves": [1, 2]}', None, None),
    ('{"other": 1}', [], []),
    ('{"sorted FENs": ["a b", "c d", ""]}', None, ["a b", "c d"]),
    ('{"sorted fens": "[a b,  c d ]"}', None, ["a b", "c d"]),
    ('{"sorted FENs": 3}', None, None),
    ("no json", None, None),
]


def test_parse_lists(spark):
    rows = [(str(i), 1, 0, c) for i, (c, *_) in enumerate(LISTS)]
    df = spark.createDataFrame(rows, "rollout_id string, prompt_id long, step long, completion string")
    got = {r["rollout_id"]: r for r in parse_completions(df).collect()}
    for i, (c, missing, fens) in enumerate(LISTS):
        r = got[str(i)]
        if "missing" in c.lower() or c == '{"other": 1}' or c == "no json":
            assert r["pred_missing"] == missing, c
        if "fen" in c.lower() or c == '{"other": 1}' or c == "no json":
            assert r["pred_fens"] == fens, c


def test_think_tokens(spark):
    rows = [("a", 1, 0, THINK + "x" * 4000 + "\n</think>\n{}"), ("b", 1, 0, THINK + "x" * 40),
            ("c", 1, 0, "<think>\nabc\n</think>"), ("d", 1, 0, THINK + "\n</think>")]
    df = spark.createDataFrame(rows, "rollout_id string, prompt_id long, step long, completion string")
    got = {r["rollout_id"]: r["think_tokens"] for r in parse_completions(df).collect()}
    assert got == {"a": 1000.0, "b": 0.0, "c": 0.0, "d": 0.0}


def test_chat_message_completion(spark):
    df = spark.createDataFrame([("a", 1, 0, [("assistant", '{"move": "e2e4"}')])],
                               "rollout_id string, prompt_id long, step long, "
                               "completion array<struct<role:string,content:string>>")
    assert parse_completions(df).collect()[0]["pred_move"] == "e2e4"
