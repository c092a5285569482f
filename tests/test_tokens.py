"""Truncation, padding, answer start and label masks."""

from rollout_tables.operators.tokens import mask_token_rows, token_audit

A, NL = 248045, 198


def _run(spark, rows, max_len, rule="answer"):
    df = spark.createDataFrame([(i, ids) for i, ids in enumerate(rows)], "conv_id long, input_ids array<int>")
    return [r for r in mask_token_rows(df, max_len, 0, rule).orderBy("conv_id").collect()]


def test_mask_after_header(spark):
    r = _run(spark, [[1, A, 3, NL, 7, 8, 9]], 10)[0]
    assert r["answer_start"] == 4 and r["n_real"] == 7
    assert r["input_ids"] == [1, A, 3, NL, 7, 8, 9, 0, 0, 0]
    assert r["labels"] == [-100] * 4 + [7, 8, 9, 0, 0, 0]
    assert r["attention_mask"] == [1] * 7 + [0] * 3


def test_trailing_empty_header(spark):
    ids = [A, 2, NL, 5, 6, A, 3, NL, 7, A, 3, NL]
    answer = _run(spark, [ids], 14)[0]
    written = _run(spark, [ids], 14, rule="last_header")[0]
    assert answer["answer_start"] == 8          # the last header with a body
    assert written["answer_start"] == 12        # as written: the empty trailing header
    assert written["labels"][:12] == [-100] * 12


def test_no_header_and_truncation(spark):
    rows = _run(spark, [[5, 6, 7], [A, 9, 9, 9, 9, 9, 9, 9, 9, 9, NL, 1], [A, 1, NL, 4, 4, 4, 4]], 5)
    assert rows[0]["answer_start"] is None and rows[0]["labels"] == [5, 6, 7, 0, 0]
    assert rows[1]["answer_start"] is None       # newline beyond the 9-token window
    assert rows[2]["input_ids"] == [A, 1, NL, 4, 4] and rows[2]["answer_start"] == 3


def test_labels_equal_ids_where_kept(spark):
    for r in _run(spark, [[A, 1, NL, 2, 3], [1, 2], [A, 2, NL, A, 3, NL, 4]], 6):
        assert all(l == -100 or l == i for l, i in zip(r["labels"], r["input_ids"]))


def test_audit(spark):
    df = spark.createDataFrame([(0, [A, 1, NL, 2, 3]), (1, [1, 2, 3, 4, 5, 6, 7])], "conv_id long, input_ids array<int>")
    a = token_audit(mask_token_rows(df, 6, 0), 6).collect()[0]
    assert (a["n_rows"], a["n_truncated"], a["n_without_answer"]) == (2, 1, 1)
    assert a["trained_tokens"] == 3 + 6


def test_user_tokenizer_then_mask(spark):
    from pyspark.sql import functions as F

    from rollout_tables.operators.messages import sft_messages
    from rollout_tables.operators.tokens import tokenize

    vocab = {"<|im_start|>": A, "\n": NL}

    def toy(texts):  # markers and newlines get their ids, other characters 1
        out = []
        for t in texts:
            ids, i = [], 0
            while i < len(t):
                if t.startswith("<|im_start|>", i):
                    ids.append(vocab["<|im_start|>"]); i += len("<|im_start|>")
                else:
                    ids.append(vocab.get(t[i], 1)); i += 1
            out.append(ids)
        return out

    recs = spark.createDataFrame([(1, "T", "K", "in", "ok")],
                                 "record_id long, task string, KIND string, input string, expected_output string")
    toks = tokenize(sft_messages(recs).select("record_id", "text"), toy)
    r = mask_token_rows(toks, 400, 0, rule="answer").collect()[0]
    # the answer "ok" follows the assistant header; only it, its close marker and padding stay
    kept = [x for x in r["labels"][:r["n_real"]] if x != -100]
    assert kept[:2] == [1, 1] and r["answer_start"] < r["n_real"]
    assert "ArrowEvalPython" in toks._jdf.queryExecution().executedPlan().toString()
    assert F is not None
