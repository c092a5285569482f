"""DuckDB SQL for every registered query that SQL can express.

The SQL is written independently of the Spark code: the same derived views
(FIXTURES.md) and the same rules, in DuckDB's dialect, over the pre-registered
driver tables. Literals shared with the Spark side come from the same
modules (fixed values and test-data parameters) so the two never drift.
"""

from __future__ import annotations

from rollout_tables.fixed_values import (
    CATEGORY_WEIGHTS, CHATML_CLOSE, CHATML_GENERATION, CHATML_OPEN, LLAMA3_EOT, LLAMA3_HEADER_CLOSE,
    LLAMA3_HEADER_OPEN, RESPOND, RESPOND_FORMAT, RESPONSE_FORMATS, SIDE_TO_MOVE, SIDE_TO_MOVE_KINDS,
    SPLITS_3WAY, SPLITS_4WAY, START_FEN, SYSTEM_KIND, SYSTEM_PREFIX, SYSTEM_TASK, THINK_CLOSE, THINK_OPEN,
)
from rollout_tables.sources import fixtures as fx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


OPENING = lst(fx.OPENING)
KINDS = lst(fx.KINDS)
WS = r"'^\s+|\s+$'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {WS}, '', 'g')"


def fen(key: str) -> str:
    return (f"(CASE WHEN {key} = '' THEN {lit(START_FEN)} ELSE {key} || CASE WHEN len(string_split({key}, ' ')) % 2 = 0 "
            f"THEN ' w - 0' ELSE ' b - 0' END END)")


def prefix_key(n: str) -> str:
    return f"array_to_string({OPENING}[1:{n}], ' ')"


def q(s: str) -> str:
    return "'\"' || " + s + " || '\"'"


RECORDS = f"""
r1 AS (
  SELECT o_orderkey AS record_id, o_orderpriority AS task, {KINDS}[(o_orderkey % 7) + 1] AS KIND,
         (o_orderkey // 7) % 13 AS n_open,
         chr((97 + o_custkey % 8)::INT) || CAST(1 + (o_custkey // 8) % 8 AS VARCHAR)
           || chr((97 + (o_custkey // 64) % 8)::INT) || CAST(1 + (o_custkey // 512) % 8 AS VARCHAR) AS pseudo
  FROM orders),
r2 AS (SELECT *, {OPENING}[1:n_open] AS moves FROM r1),
r3 AS (SELECT *, CASE WHEN KIND = 'MLM_ON_MOVES' AND n_open >= 2
                      THEN list_transform(moves || [pseudo], lambda m, i: CASE WHEN i = 2 THEN '?' ELSE m END)
                      ELSE moves || [pseudo] END AS played FROM r2),
r4 AS (SELECT *, array_to_string(played, ' ') AS played_key, array_to_string(moves, ' ') AS prefix_key FROM r3),
records AS (
  SELECT record_id, task, KIND,
         CASE WHEN record_id % 97 = 0 THEN ''
              WHEN record_id % 11 = 0 THEN 'Moves played: ' || played_key
              ELSE '{{"moves": [' || array_to_string(list_transform(played, lambda m: {q('m')}), ', ')
                   || '], "FEN": "' || {fen('played_key')} || '"}}' END AS input,
         '{{"move": "' || pseudo || '"}}' AS expected_output, moves, [{fen('prefix_key')}] AS FENs
  FROM r4)"""


def _instruction(kind: str, with_side: bool, side: str = "") -> str:
    parts = []
    for k, fmt in RESPONSE_FORMATS.items():
        if with_side and k in SIDE_TO_MOVE_KINDS:
            text = f"{lit(chr(10) * 2 + SIDE_TO_MOVE)} || {side} || {lit(chr(10) * 2 + RESPOND_FORMAT + fmt)}"
        else:
            text = lit(" " + RESPOND_FORMAT + fmt)
        parts.append(f"WHEN {kind} = {lit(k)} THEN {text}")
    return "CASE " + " ".join(parts) + f" ELSE {lit(' ' + RESPOND)} END"


def _msg(role: str, content: str) -> str:
    return f"{{'role': {lit(role)}, 'content': {content}}}"


PROMPTS = f"""
p0 AS (SELECT *, CASE WHEN json_valid(input) THEN input ELSE 'null' END AS jv FROM records),
p1 AS (
  SELECT record_id, coalesce(task, '') AS task, coalesce(KIND, '') AS kind, coalesce(input, '') AS input,
         CASE WHEN json_type(jv) = 'OBJECT'
              THEN coalesce((jv::JSON -> 'moves')::VARCHAR[], []) ELSE coalesce(moves, []) END AS moves,
         CASE WHEN json_type(jv) = 'OBJECT'
              THEN [jv::JSON ->> 'FEN'] ELSE coalesce(FENs, []) END AS fens
  FROM p0),
p2 AS (
  SELECT *, CASE WHEN len(moves) % 2 = 0 THEN 'White' ELSE 'Black' END AS side,
         {lit(SYSTEM_PREFIX)} || CASE WHEN task <> '' THEN {lit(SYSTEM_TASK)} || task ELSE '' END
           || CASE WHEN kind <> '' THEN {lit(SYSTEM_KIND)} || kind ELSE '' END AS system_text
  FROM p1),
prompts AS (
  SELECT record_id, kind AS category, moves, fens,
         CASE WHEN task <> '' OR input <> ''
              THEN [{_msg('system', 'system_text')},
                    {_msg('user', "CASE WHEN kind <> '' THEN input || " + _instruction('kind', True, 'side') + " ELSE input END")}]
              ELSE [] END AS prompt
  FROM p2)"""

EVALS = f"""
base AS (
  SELECT array_to_string(moves, ' ') AS position_key FROM prompts
  UNION ALL SELECT {prefix_key('n')} FROM range(0, {len(fx.OPENING) + 1}) t(n)),
children AS (
  SELECT concat_ws(' ', nullif(position_key, ''), m) AS position_key FROM base, unnest({OPENING}) u(m)),
keys AS (
  SELECT DISTINCT position_key FROM (
    SELECT position_key FROM base
    UNION ALL SELECT position_key FROM children WHERE ('0x' || substr(md5(position_key), 2, 1))::INT % 3 <> 0)
  WHERE (position_key = '' OR NOT starts_with(md5(position_key), 'f')) AND NOT contains(position_key, '?')),
k2 AS (SELECT position_key, md5(position_key) AS h,
              (('0x' || substr(md5(position_key), 1, 4))::INT % 1601 - 800)::INT AS v FROM keys),
evals AS (
  SELECT position_key, {fen('position_key')} AS fen,
         CASE WHEN substr(h, 32, 1) = '0' THEN 'mate' ELSE 'cp' END AS eval_type, v AS eval_value,
         {OPENING}[('0x' || substr(h, 5, 1))::INT % 12 + 1] AS best_move,
         [{", ".join(f"{{'move': {OPENING}[('0x' || substr(h, {5 + i}, 1))::INT % 12 + 1], 'score': (v - {15 * i})::INT, 'mate': NULL::INT, 'depth': 15}}" for i in range(5))}] AS top_moves
  FROM k2)"""

_ANSWER_KEYS = lst([fx.ANSWER_KEYS[k] for k in fx.KINDS])
ROLLOUTS = f"""
o1 AS (
  SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
                   CAST(round(l_quantity * 100) AS BIGINT)::VARCHAR, CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR)
           AS rollout_id,
         CASE WHEN l_partkey % 97 = 0 THEN -l_orderkey WHEN l_partkey % 97 <> 1 THEN l_orderkey END AS prompt_id, l_orderkey % 2000 AS step, {KINDS}[(l_orderkey % 7) + 1] AS kind,
         {_ANSWER_KEYS}[(l_orderkey % 7) + 1] AS akey, l_suppkey + l_partkey // 10 AS h, l_partkey % 10 AS n
  FROM lineitem),
o2 AS (
  SELECT *, {OPENING}[h % 12 + 1] AS mv, {OPENING}[(h // 12) % 12 + 1] AS mv2,
         {fen(prefix_key('h % 13'))} AS f0, {fen(prefix_key('(h // 13) % 13'))} AS f1,
         {fen(prefix_key('(h // 169) % 13'))} AS f2
  FROM o1),
o3 AS (
  SELECT *, CASE WHEN kind = 'FIND_ADVANTAGED_PLAYER' THEN {q(lst(fx.ADVANTAGE_WORDS) + '[h % 3 + 1]')}
                 WHEN kind = 'FIND_FINAL_SCORE' THEN {q(lst(fx.SCORE_WORDS) + '[h % 3 + 1]')}
                 WHEN kind = 'MLM_ON_MOVES' THEN '[' || {q('mv')} || ', ' || {q('mv2')} || ']'
                 WHEN kind = 'SORT_FENS' THEN '[' || {q('f0')} || ', ' || {q('f1')} || ', ' || {q('f2')} || ']'
                 ELSE {q('mv')} END AS val
  FROM o2),
o4 AS (SELECT *, '{{"' || akey || '": ' || val || '}}' AS obj FROM o3),
rollouts AS (
  SELECT rollout_id, prompt_id, step,
    CASE n
      WHEN 0 THEN obj
      WHEN 1 THEN replace(obj, '"', '''')
      WHEN 2 THEN '{{"' || upper(akey) || '": ' || val || '}}'
      WHEN 3 THEN CASE WHEN kind = 'FIND_FINAL_SCORE' THEN ' ' || {lst(fx.SCORE_WORDS)}[h % 3 + 1] || ' '
                       ELSE 'I think ' || mv || ' is strong'
                            || {lst([" for white.", " for white, not black.", ", it is a draw."])}[h % 3 + 1] END
      WHEN 4 THEN {lit(THINK_OPEN)}
                  || CASE WHEN h % 2 = 0 THEN repeat('a', 1200) ELSE repeat('a', 4000) END
                  || {lit(THINK_CLOSE + chr(10))} || obj
      WHEN 5 THEN '{{"answer": ' || obj || '}}'
      WHEN 6 THEN CASE WHEN h % 2 = 0 THEN '"1-0"' ELSE '[1]' END
      WHEN 7 THEN '{{"note": "' || mv || '"}}'
      WHEN 8 THEN CASE WHEN kind = 'SORT_FENS'
                       THEN '{{"sorted FENs": [' || {q('f0')} || ', ' || {q("'x' || f1")} || ', ' || {q('f2')} || ']}}'
                       WHEN h % 2 = 0 THEN '{{"missing moves": [' || {q('mv')} || ', ' || {q('mv')} || ', "?"]}}'
                       ELSE '{{"missing moves": "[' || mv || ', ' || mv2 || ', ?]"}}' END
      ELSE '' END AS completion
  FROM o4)"""


def _first_key(pred: str) -> str:
    return f"list_filter(keys, lambda k: {pred})[1]"


def _has(words) -> str:
    return " AND ".join(f"contains(lower(k), {lit(w)})" for w in words)


THINK = lit("(?s)" + THINK_OPEN.replace("|", "\\|") + "(.*?)" + THINK_CLOSE)


def parsed(source: str) -> str:
    """PARSE CTEs over ``source`` (needs ``completion``); result ``parsed``."""
    return f"""
x1 AS (SELECT *, regexp_extract(completion, '\\{{[^{{}}]*\\}}', 0) AS found FROM {source}),
x2 AS (SELECT *, replace(CASE WHEN found = '' THEN completion ELSE found END, '''', '"') AS j0 FROM x1),
x2b AS (SELECT * EXCLUDE (j0), CASE WHEN json_valid(j0) THEN j0 ELSE 'null' END AS j2, json_valid(j0) AS valid FROM x2),
x3 AS (
  SELECT *, (found <> '' AND valid AND json_type(j2) = 'OBJECT') AS is_obj,
         (found = '' AND valid) AS is_scalar FROM x2b),
x4 AS (
  SELECT *, CASE WHEN is_obj THEN 'object' WHEN is_scalar THEN 'non_object' ELSE 'text' END AS json_state,
         CASE WHEN is_obj THEN json_keys(j2) ELSE [] END AS keys FROM x3),
x5 AS (
  SELECT *,
    coalesce({_first_key("lower(k) = 'next best move'")}, {_first_key("lower(k) = 'missing move'")},
             {_first_key("lower(k) = 'move'")}, {_first_key("lower(k) = 'best move'")}) AS k_move,
    {_first_key(_has(['advantage', 'most']))} AS k_adv,
    {_first_key(_has(['score']))} AS k_score,
    {_first_key(_has(['missing', 'move']))} AS k_missing,
    {_first_key(_has(['sorted', 'fen']))} AS k_fens
  FROM x4),
x6 AS (
  SELECT *,
    CASE WHEN is_obj AND k_move IS NOT NULL THEN {strip('j2::JSON ->> k_move')}
         ELSE regexp_extract(completion, '[a-h][1-8][a-h][1-8]', 0) END AS pred_move,
    CASE WHEN is_obj THEN lower(coalesce({strip('j2::JSON ->> k_adv')}, ''))
         WHEN contains(lower(completion), 'white') AND NOT contains(lower(completion), 'black') THEN 'white'
         WHEN contains(lower(completion), 'black') AND NOT contains(lower(completion), 'white') THEN 'black'
         WHEN contains(lower(completion), 'draw') THEN 'draw'
         ELSE regexp_extract(lower(completion), 'white|black|draw', 0) END AS pred_advantage,
    {strip("lower(CASE WHEN is_obj THEN coalesce(" + strip('j2::JSON ->> k_score') + ", '') ELSE " + strip("trim(trim(" + strip('completion') + ", '\"'), '''')") + " END)")} AS pred_score,
    CASE WHEN NOT is_obj THEN NULL
         WHEN k_missing IS NULL OR json_type(j2::JSON -> k_missing) = 'VARCHAR' THEN
           list_filter(list_transform(string_split(replace(replace(coalesce(j2::JSON ->> k_missing, ''), '[', ''), ']', ''), ','),
                                      lambda p: trim({strip('p')}, '"''')), lambda p: p <> '' AND p <> '?')
         WHEN json_type(j2::JSON -> k_missing) = 'ARRAY' THEN
           list_transform(list_filter((j2::JSON -> k_missing)::VARCHAR[], lambda m: {strip('m')} <> ''),
                          lambda m: trim({strip('m')}, '[]"'''))
         END AS pred_missing,
    CASE WHEN NOT is_obj THEN NULL
         WHEN k_fens IS NULL OR json_type(j2::JSON -> k_fens) = 'VARCHAR' THEN
           list_transform(list_filter(string_split(trim(coalesce(j2::JSON ->> k_fens, ''), '[]'), ','), lambda f: {strip('f')} <> ''),
                          lambda f: trim({strip('f')}, '"'''))
         WHEN json_type(j2::JSON -> k_fens) = 'ARRAY' THEN
           list_transform(list_filter((j2::JSON -> k_fens)::VARCHAR[], lambda f: {strip('f')} <> ''),
                          lambda f: trim(f, '"'''))
         END AS pred_fens,
    length(regexp_extract(completion, {THINK}, 1)) / 4.0 AS think_tokens
  FROM x5),
parsed AS (SELECT * EXCLUDE (found, j2, valid, is_obj, is_scalar, keys, k_move, k_adv, k_score, k_missing, k_fens) FROM x6)"""


RESOLVED = """
resolved AS (
  SELECT p.record_id, p.category, p.moves, p.fens, array_to_string(p.moves, ' ') AS position_key,
         e.position_key IS NOT NULL AS position_found,
         CASE WHEN e.position_key IS NOT NULL THEN e.position_key ELSE '' END AS resolved_key,
         CASE WHEN e.position_key IS NOT NULL THEN e.fen ELSE (SELECT fen FROM evals WHERE position_key = '') END AS fen,
         CASE WHEN e.position_key IS NOT NULL THEN e.eval_type ELSE (SELECT eval_type FROM evals WHERE position_key = '') END AS eval_type,
         CASE WHEN e.position_key IS NOT NULL THEN e.eval_value ELSE (SELECT eval_value FROM evals WHERE position_key = '') END AS eval_value,
         CASE WHEN e.position_key IS NOT NULL THEN e.best_move ELSE (SELECT best_move FROM evals WHERE position_key = '') END AS best_move,
         CASE WHEN e.position_key IS NOT NULL THEN e.top_moves ELSE (SELECT top_moves FROM evals WHERE position_key = '') END AS top_moves
  FROM prompts p
  LEFT JOIN evals e ON e.position_key = array_to_string(p.moves, ' '))"""


def scaled(cp: str, white: str = "TRUE") -> str:
    c = f"greatest(-5000, least(5000, {cp}))"
    return f"greatest(-1.0, least(1.0, tanh((CASE WHEN {white} THEN {c} ELSE -{c} END) / 200.0)))"


def linear(cp: str, white: str = "TRUE") -> str:
    c = f"greatest(-5000, least(5000, {cp}))"
    return f"greatest(-1.0, least(1.0, (CASE WHEN {white} THEN {c} ELSE -{c} END) / 500.0))"


def _scored(scaling: str = "tanh", draw_credit: bool = False) -> str:
    to_r = linear if scaling == "linear" else scaled
    cp = "coalesce(eval_value, 0)"
    s = scaled(cp)
    wrong_adv = f"greatest(-0.5, -abs({s}))"
    if draw_credit:
        wrong_adv = f"CASE WHEN pred_advantage = 'draw' OR adv_expected = 'draw' THEN -0.2 ELSE {wrong_adv} END"
    top5 = "list_transform(top_moves[1:5], lambda m: m.move)"
    return f"""
xj AS (SELECT r.rollout_id, r.prompt_id, r.step, r.completion, coalesce(p.category, '') AS category,
              coalesce(p.position_found, false) AS position_found, p.resolved_key, p.fen, p.eval_type, p.eval_value, p.best_move, p.top_moves
       FROM rollouts r LEFT JOIN resolved p ON r.prompt_id = p.record_id),
{parsed('xj')},
nx AS (
  SELECT x.*, a.eval_value AS after_cp, a.fen AS after_fen FROM parsed x
  LEFT JOIN evals a ON a.position_key = CASE WHEN x.category = 'FIND_NEXT_BEST_MOVE' AND x.json_state <> 'non_object'
                                              AND x.pred_move <> ''
                                             THEN concat_ws(' ', nullif(x.resolved_key, ''), x.pred_move) END),
fe AS (
  SELECT x.rollout_id, u.pos, e.eval_value AS fen_cp
  FROM (SELECT rollout_id, unnest(pred_fens) AS f, generate_subscripts(pred_fens, 1) AS pos FROM parsed
        WHERE category = 'SORT_FENS' AND json_state = 'object' AND len(pred_fens) >= 2) u
  JOIN parsed x ON x.rollout_id = u.rollout_id
  LEFT JOIN (SELECT fen, arg_min(eval_value, position_key) AS eval_value FROM evals GROUP BY fen) e ON e.fen = u.f),
fv AS (
  SELECT rollout_id, sum(CASE WHEN fen_cp IS NOT NULL AND (prev IS NULL OR fen_cp >= prev) THEN 1 ELSE 0 END) AS valid_count
  FROM (SELECT *, last_value(fen_cp IGNORE NULLS) OVER (PARTITION BY rollout_id ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM fe)
  GROUP BY rollout_id),
ru AS (
  SELECT nx.*, fv.valid_count,
    CASE WHEN {cp} > 50 THEN 'white' WHEN {cp} < -50 THEN 'black' ELSE 'draw' END AS adv_expected,
    CASE WHEN {cp} > 200 THEN '1-0' WHEN {cp} < -200 THEN '0-1' ELSE '1/2-1/2' END AS score_expected
  FROM nx LEFT JOIN fv ON fv.rollout_id = nx.rollout_id),
scored0 AS (
  SELECT *, CAST(CASE category
    WHEN 'FIND_NEXT_BEST_MOVE' THEN
      CASE WHEN json_state <> 'non_object' AND after_cp IS NOT NULL
           THEN {to_r('after_cp', "coalesce(contains(after_fen, ' w '), (CASE WHEN resolved_key = '' THEN 1 ELSE len(string_split(resolved_key, ' ')) + 1 END) % 2 = 0)")} ELSE -0.1 END
    WHEN 'FIND_ADVANTAGED_PLAYER' THEN
      CASE WHEN json_state = 'non_object' THEN -1.0
           WHEN pred_advantage = adv_expected THEN
             CASE WHEN abs({cp}) > 200 THEN greatest(0.5, {s}) WHEN abs({cp}) > 50 THEN greatest(0.2, {s} * 0.5)
                  WHEN abs({cp}) > 25 THEN greatest(0.0, {s} * 0.3) ELSE greatest(-0.1, {s} * 0.2) END
           ELSE {wrong_adv} END
    WHEN 'FIND_FINAL_SCORE' THEN
      CASE WHEN json_state = 'non_object' THEN -1.0
           WHEN pred_score = score_expected THEN
             CASE WHEN abs({cp}) > 400 THEN greatest(0.5, {s}) WHEN abs({cp}) > 200 THEN greatest(0.3, {s} * 0.8)
                  WHEN abs({cp}) > 100 THEN greatest(0.1, {s} * 0.5) ELSE greatest(-0.1, {s} * 0.3) END
           WHEN pred_score = '1/2-1/2' OR score_expected = '1/2-1/2' THEN -0.15
           ELSE greatest(-0.5, -abs({s})) END
    WHEN 'MLM_ON_MOVES' THEN
      CASE WHEN json_state <> 'object' OR pred_missing IS NULL OR len(pred_missing) = 0 THEN -1.0
           ELSE 0.5 + 0.5 * len(list_filter(pred_missing, lambda m: list_contains({top5}, m) OR m = best_move))
                / len(pred_missing) END
    WHEN 'FIND_LAST_MOVE' THEN
      CASE WHEN json_state = 'non_object' THEN -1.0 WHEN coalesce(pred_move, '') = '' THEN -0.5
           WHEN pred_move = best_move THEN 1.0 WHEN list_contains({top5}, pred_move) THEN 0.5 ELSE -0.25 END
    WHEN 'SORT_FENS' THEN
      CASE WHEN json_state <> 'object' OR pred_fens IS NULL OR len(pred_fens) < 2 THEN -1.0
           ELSE 0.5 + 0.5 * coalesce(valid_count, 0) / len(pred_fens) END
    ELSE 0.0 END AS DOUBLE) AS reward_raw
  FROM ru),
scored AS (
  SELECT *, CASE WHEN think_tokens > 500 THEN 0.1 * (1 - exp(-(think_tokens - 500) / 300.0)) ELSE 0.0 END AS penalty,
         reward_raw - CASE WHEN think_tokens > 500 THEN 0.1 * (1 - exp(-(think_tokens - 500) / 300.0)) ELSE 0.0 END
           AS reward
  FROM scored0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip().rstrip(",") for c in ctes) + "\n"


def _split_sql(table: str, ratios, id_col: str = "doc_id") -> str:
    sizes = [f"floor(n * CAST({r} AS DOUBLE))" for _, r in ratios]
    first = f"(n - {' - '.join(sizes)} + {sizes[0]})"
    bounds, acc = [], []
    for i, _ in enumerate(ratios):
        acc.append(first if i == 0 else sizes[i])
        bounds.append(" + ".join(acc))
    case = " ".join(f"WHEN split_rank <= {b} THEN {lit(name)}" for (name, _), b in zip(ratios, bounds))
    return f"""
ranked AS (SELECT {id_col}, row_number() OVER (ORDER BY md5('42:' || {id_col}::VARCHAR) NULLS LAST, {id_col}) AS split_rank,
                  count(*) OVER () AS n FROM {table}),
assigned AS (SELECT {id_col}, split_rank, CASE {case} END AS split FROM ranked)"""


def _split_order(ratios) -> str:
    return "CASE split " + " ".join(f"WHEN {lit(n)} THEN {i}" for i, (n, _) in enumerate(ratios)) + " END"


def _chatml(msgs: str) -> str:
    return (f"coalesce(array_to_string(list_transform({msgs}, lambda m: {lit(CHATML_OPEN)} || coalesce(m.role, '') || "
            f"{lit(chr(10))} || coalesce(m.content, '') || {lit(CHATML_CLOSE)}), ''), '') || {lit(CHATML_GENERATION)}")


def _flat_msgs(msgs: str) -> str:
    return f"array_to_string(list_transform({msgs}, lambda m: concat_ws({lit(chr(9))}, m.role, m.content)), {lit(chr(30))})"


CONVERSATIONS = """
conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
         FROM conversations GROUP BY conv_id)"""

# a real token must follow the header (dropped for the rule as written)
LAST_WITH_ANSWER = "\n  AND (i - 1) + list_position(ids[i + 1:i + 9], 198) + 1 < n_real"
TOKENS = f"""
tr AS (
  SELECT conv_id,
    flatten(list_transform(messages, lambda m: [248045, CASE m.role WHEN 'system' THEN 1 WHEN 'user' THEN 2
                                                                    WHEN 'assistant' THEN 3 ELSE 0 END, 198]
                           || list_transform(string_split(coalesce(m.content, ''), ' '), lambda w: length(w)::INT)
                           || [{fx.MESSAGE_END_ID}])) AS ids0
  FROM conv),
t1 AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN ids0 || [248045, 3, 198] ELSE ids0 END AS ids FROM tr),
t2 AS (SELECT conv_id, len(ids) AS n_ids, ids[1:{fx.TOKEN_ROW_LENGTH}] AS tids FROM t1),
t3 AS (SELECT conv_id, n_ids, len(tids) AS n_real,
              tids || list_transform(range(greatest({fx.TOKEN_ROW_LENGTH} - len(tids), 0)), lambda z: {fx.PAD_ID}) AS ids
       FROM t2),
t4 AS (SELECT *, list_max(list_transform(ids, lambda x, i:
          CASE WHEN x = 248045 AND list_contains(ids[i + 1:i + 9], 198){LAST_WITH_ANSWER} THEN i - 1 END)) AS hdr
       FROM t3),
t5 AS (SELECT *, CASE WHEN hdr IS NOT NULL THEN hdr + list_position(ids[hdr + 2:hdr + 10], 198) + 1 END AS answer_start
       FROM t4),
masked AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN answer_start IS NOT NULL AND i - 1 < answer_start
                                                           THEN -100 ELSE x END) AS labels FROM t5)"""


def _reward_of(category: str, **kw) -> str:
    return (with_(RECORDS, PROMPTS, EVALS, ROLLOUTS, RESOLVED, _scored(**kw))
            + f"SELECT rollout_id, prompt_id, json_state, position_found, (round(reward_raw, 6) + 0.0) AS reward_raw "
              f"FROM scored WHERE category = {lit(category)}")


ALL = with_(RECORDS, PROMPTS, EVALS, ROLLOUTS, RESOLVED, _scored())
# a mate in n counts as 10,000 + n centipawns
EVALS_MATE_SCALED = EVALS.replace("v AS eval_value", "(CASE WHEN substr(h, 32, 1) = '0' THEN 10000 + v ELSE v END)::INT AS eval_value")

SPARSE_STEPS = ",\nsparse AS (SELECT * REPLACE ((step % 50) * (step % 50) AS step) FROM scored)"


def _trend(source: str) -> str:
    """Change of the mean between neighbouring intervals that have rewards,
    for 1,000 steps of their true distance."""
    return f"""
, per AS (SELECT CAST(floor(step / 100) * 100 AS BIGINT) AS interval_start, avg(reward) AS mean_reward FROM {source} GROUP BY 1),
changes AS (
  SELECT p.interval_start, p.mean_reward, (p.mean_reward - o.mean_reward) / (p.interval_start - o.interval_start) * 1000 AS gain
  FROM per p LEFT JOIN per o ON o.interval_start = (SELECT max(x.interval_start) FROM per x WHERE x.interval_start < p.interval_start))"""


TREND_COLUMNS = """(round(mean_reward, 6) + 0.0) AS mean_reward, (round(gain, 6) + 0.0) AS gain_per_1000_steps, gain >= 0.1 AS meets_target"""

ORACLE = {
    "split_3way_assign": with_(_split_sql("documents", SPLITS_3WAY)) + "SELECT doc_id, split_rank, split FROM assigned",
    "split_4way_assign": with_(_split_sql("documents", SPLITS_4WAY)) + "SELECT doc_id, split_rank, split FROM assigned",
    "split_4way_unranked": with_("li AS (SELECT CASE WHEN l_partkey % 7 <> 0 THEN l_orderkey END AS record_id FROM lineitem)",
                                 _split_sql("li", SPLITS_4WAY, "record_id")) + "SELECT record_id, split FROM assigned",
    "split_size_report": with_(_split_sql("labels", SPLITS_3WAY)) + f"""
SELECT split, {_split_order(SPLITS_3WAY)} AS split_order, count(*) AS n,
       (round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0) AS pct FROM assigned GROUP BY split""",
    "split_size_report_footers": with_(_split_sql("documents", SPLITS_4WAY)) + f"""
SELECT split, {_split_order(SPLITS_4WAY)} AS split_order, count(*) AS n,
       (round(count(*) * 100.0 / sum(count(*)) OVER (), 6) + 0.0) AS pct FROM assigned GROUP BY split""",
    "split_resolve": with_(_split_sql("documents", SPLITS_4WAY)) + """
SELECT doc_id, split, CASE split WHEN 'sft_train' THEN 'train' ELSE 'eval' END AS use
FROM assigned WHERE split IN ('sft_train', 'sft_val')""",
    "split_resolve_rl": with_(_split_sql("documents", SPLITS_4WAY)) + """
SELECT doc_id, 'requested' AS arm, true AS has_eval FROM assigned WHERE split = 'rl'
UNION ALL SELECT doc_id, 'train', true FROM assigned WHERE split = 'sft_train'
UNION ALL SELECT doc_id, 'whole', false FROM documents""",
    "sft_messages": with_(RECORDS, f"""
sm AS (SELECT record_id, CASE WHEN coalesce(input, '') <> '' THEN
         [{_msg('system', lit(SYSTEM_PREFIX + SYSTEM_TASK) + " || coalesce(task, '') || " + lit(SYSTEM_KIND) + " || coalesce(KIND, '')")},
          {_msg('user', 'input')}, {_msg('assistant', "coalesce(expected_output, '')")}] ELSE [] END AS messages
       FROM records)""") + f"""
SELECT record_id, len(messages)::BIGINT AS n_messages, {_flat_msgs('messages')} AS messages, {_chatml('messages')} AS text FROM sm""",
    "rl_prompts": with_(RECORDS, PROMPTS) + f"""
SELECT record_id, category, array_to_string(moves, ' ') AS moves, array_to_string(fens, '|') AS fens,
       len(prompt)::BIGINT AS n_messages, {_flat_msgs('prompt')} AS prompt FROM prompts""",
    "rl_prompts_with_answer": with_(RECORDS, f"""
sm AS (SELECT record_id, CASE WHEN coalesce(input, '') <> '' THEN
         [{_msg('system', lit(SYSTEM_PREFIX + SYSTEM_TASK) + " || coalesce(task, '') || " + lit(SYSTEM_KIND) + " || coalesce(KIND, '')")},
          {_msg('user', 'input || ' + _instruction('KIND', False))}, {_msg('assistant', "coalesce(expected_output, '')")}]
         ELSE [] END AS messages
       FROM records)""") + f"""
SELECT record_id, len(messages)::BIGINT AS n_messages, {_flat_msgs('messages')} AS messages, {_chatml('messages')} AS text FROM sm""",
    "conversation_text_chatml": with_(CONVERSATIONS) + f"SELECT conv_id, {_chatml('messages')} AS text FROM conv",
    "conversation_text_llama3": with_(CONVERSATIONS) + f"""
SELECT conv_id, coalesce(array_to_string(list_transform(messages, lambda m, i: {lit(LLAMA3_HEADER_OPEN)} || coalesce(m.role, '')
         || {lit(LLAMA3_HEADER_CLOSE)}
         || CASE WHEN i = 1 AND m.role = 'system' THEN coalesce(m.content, '') ELSE {strip("coalesce(m.content, '')")} END
         || {lit(LLAMA3_EOT + chr(10))}), ''), '')
       || {lit(LLAMA3_HEADER_OPEN + 'assistant' + LLAMA3_HEADER_CLOSE)} AS text FROM conv""",
    "token_rows_masked": with_(CONVERSATIONS, TOKENS) + """
SELECT conv_id, n_ids::BIGINT AS n_ids, n_real::BIGINT AS n_real, answer_start::BIGINT AS answer_start,
       array_to_string(ids, ',') AS input_ids, CAST(n_real AS BIGINT) AS n_attended, array_to_string(labels, ',') AS labels
FROM masked""",
    "token_rows_last_header": with_(CONVERSATIONS, TOKENS.replace(LAST_WITH_ANSWER, "")) + """
SELECT conv_id, n_ids::BIGINT AS n_ids, n_real::BIGINT AS n_real, answer_start::BIGINT AS answer_start,
       array_to_string(ids, ',') AS input_ids, CAST(n_real AS BIGINT) AS n_attended, array_to_string(labels, ',') AS labels
FROM masked""",
    "token_audit": with_(CONVERSATIONS, TOKENS) + f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE n_ids > {fx.TOKEN_ROW_LENGTH}) AS n_truncated,
       count(*) FILTER (WHERE answer_start IS NULL) AS n_without_answer,
       CAST(sum(len(list_filter(labels, lambda x: x <> -100))) AS BIGINT) AS trained_tokens,
       (round(avg(len(list_filter(labels, lambda x: x <> -100))), 6) + 0.0) AS mean_trained_tokens
FROM masked""",
    "completion_parse": with_(ROLLOUTS, parsed("rollouts")) + """
SELECT rollout_id, json_state, pred_move, pred_advantage, pred_score, (round(think_tokens, 6) + 0.0) AS think_tokens FROM parsed""",
    "completion_parse_strip_think": with_(ROLLOUTS, f"""
hidden AS (SELECT * REPLACE (replace(completion, {lit(THINK_CLOSE)}, {lit('{"move": "a1a1", "score": "1-0"}' + THINK_CLOSE)}) AS completion) FROM rollouts),
outside AS (SELECT rollout_id, length(regexp_extract(completion, {THINK}, 1)) / 4.0 AS thought,
                   regexp_replace(completion, {THINK}, '') AS completion FROM hidden)""", parsed("outside")) + """
SELECT rollout_id, json_state, pred_move, pred_advantage, pred_score, (round(thought, 6) + 0.0) AS think_tokens FROM parsed""",
    "completion_lists": with_(ROLLOUTS, parsed("rollouts")) + """
SELECT rollout_id, json_state, array_to_string(pred_missing, '|') AS pred_missing, len(pred_missing)::BIGINT AS n_missing,
       array_to_string(pred_fens, '|') AS pred_fens, len(pred_fens)::BIGINT AS n_fens FROM parsed""",
    "position_lookup": with_(RECORDS, PROMPTS, EVALS, RESOLVED) + """
SELECT record_id, position_key, position_found, resolved_key, eval_type, eval_value::BIGINT AS eval_value,
       (CASE WHEN eval_type = 'mate' THEN 10000 + eval_value ELSE coalesce(eval_value, 0) END)::BIGINT AS cp_scaled,
       best_move, array_to_string(list_transform(top_moves[1:3], lambda m: m.move), ' ') AS top3,
       CASE WHEN fen IS NOT NULL THEN contains(fen, ' w ') ELSE len(moves) % 2 = 0 END AS white_to_move
FROM resolved""",
    "positions_to_evaluate": ALL + """
SELECT DISTINCT 'position' AS kind, key FROM (
  SELECT array_to_string(moves, ' ') AS key FROM prompts
  UNION ALL
  SELECT concat_ws(' ', nullif(resolved_key, ''), pred_move) FROM parsed
  WHERE category = 'FIND_NEXT_BEST_MOVE' AND json_state <> 'non_object' AND pred_move <> '') k
WHERE NOT contains(key, '?') AND key NOT IN (SELECT position_key FROM evals)
UNION ALL
SELECT DISTINCT 'fen' AS kind, f AS key FROM (
  SELECT unnest(pred_fens) AS f FROM parsed WHERE category = 'SORT_FENS' AND len(pred_fens) >= 2) u
WHERE f NOT IN (SELECT fen FROM evals)""",
    "evaluation_ledger": with_(RECORDS, PROMPTS, EVALS) + """
SELECT 'position' AS kind, position_key AS key, (eval_value + CASE WHEN eval_type = 'mate' THEN 1000 ELSE 0 END)::INT AS eval_value, true AS known FROM evals
UNION ALL SELECT 'fen', fen, max(eval_value), true FROM evals WHERE length(position_key) < 12 GROUP BY fen
UNION ALL SELECT DISTINCT 'fen', fen, NULL::INT, false FROM evals
WHERE fen NOT IN (SELECT fen FROM evals WHERE length(position_key) < 12)""",
    "reward_next_move": _reward_of("FIND_NEXT_BEST_MOVE"),
    "reward_advantage": _reward_of("FIND_ADVANTAGED_PLAYER"),
    "reward_advantage_draw_credit": _reward_of("FIND_ADVANTAGED_PLAYER", draw_credit=True),
    "reward_final_score": _reward_of("FIND_FINAL_SCORE"),
    "reward_missing_moves": _reward_of("MLM_ON_MOVES"),
    "reward_last_move": _reward_of("FIND_LAST_MOVE"),
    "reward_sort_fens": _reward_of("SORT_FENS"),
    "reward_linear": _reward_of("FIND_NEXT_BEST_MOVE", scaling="linear"),
    "reward_all": ALL + """
SELECT rollout_id, category, json_state, (round(reward_raw, 6) + 0.0) AS reward_raw, (round(think_tokens, 6) + 0.0) AS think_tokens,
       (round(penalty, 6) + 0.0) AS penalty, (round(reward, 6) + 0.0) AS reward FROM scored""",
    "reward_all_mate_scaled": with_(RECORDS, PROMPTS, EVALS_MATE_SCALED, ROLLOUTS, RESOLVED, _scored()) + """
SELECT rollout_id, category, (round(reward_raw, 6) + 0.0) AS reward_raw, (round(reward, 6) + 0.0) AS reward FROM scored""",
    "reward_weighted": ALL.rstrip() + ",\nweights(category, weight) AS (VALUES " + ", ".join(
        f"({lit(c)}, {w})" for c, w in CATEGORY_WEIGHTS) + """)
SELECT s.category, count(*) AS n, (round(avg(reward), 6) + 0.0) AS mean_reward,
       (round(sum(coalesce(w.weight, 1.0) * reward) / sum(coalesce(w.weight, 1.0)), 6) + 0.0) AS weighted_mean_reward
FROM scored s LEFT JOIN weights w ON w.category = s.category GROUP BY ROLLUP (s.category)""",
    "group_advantage": ALL + """
, g AS (SELECT prompt_id, avg(reward) AS group_mean, stddev_samp(reward) AS group_std, count(*) AS group_size
       FROM scored GROUP BY prompt_id)
SELECT s.rollout_id, s.prompt_id, (round(s.reward, 6) + 0.0) AS reward, (round(g.group_mean, 6) + 0.0) AS group_mean,
       (round(g.group_std, 6) + 0.0) AS group_std, g.group_size,
       (round(CASE WHEN g.group_size > 1 THEN (s.reward - g.group_mean) / (g.group_std + 0.0001) ELSE 0.0 END, 6) + 0.0) AS advantage
FROM scored s JOIN g ON g.prompt_id IS NOT DISTINCT FROM s.prompt_id""",
    "reward_by_interval": ALL + """
SELECT CAST(floor(step / 10) * 10 AS BIGINT) AS interval_start, count(*) AS n, (round(avg(reward), 6) + 0.0) AS reward,
       (round(stddev_samp(reward), 6) + 0.0) AS reward_std FROM scored GROUP BY 1""",
    "reward_trend": ALL + _trend("scored") + f"""
SELECT interval_start, {TREND_COLUMNS} FROM changes""",
    "reward_by_interval_complete": ALL + SPARSE_STEPS + """
, per AS (SELECT CAST(floor(step / 10) * 10 AS BIGINT) AS interval_start, count(*) AS n, avg(reward) AS m, stddev_samp(reward) AS s
          FROM sparse GROUP BY 1),
axis AS (SELECT unnest(range((SELECT min(interval_start) FROM per), (SELECT max(interval_start) FROM per) + 1, 10)) AS interval_start)
SELECT interval_start, coalesce(n, 0) AS n, (round(m, 6) + 0.0) AS reward, (round(s, 6) + 0.0) AS reward_std
FROM axis LEFT JOIN per USING (interval_start)""",
    "reward_trend_complete": ALL + SPARSE_STEPS + _trend("sparse") + f"""
, axis AS (SELECT unnest(range((SELECT min(interval_start) FROM per), (SELECT max(interval_start) FROM per) + 1, 100)) AS interval_start)
SELECT interval_start, {TREND_COLUMNS} FROM axis LEFT JOIN changes USING (interval_start)""",
    "reward_slope": ALL + """
, sums AS (SELECT category, count(*) AS n, min(step) AS first_step, max(step) AS last_step, avg(step) AS mx, avg(reward) AS my
           FROM scored GROUP BY ROLLUP (category)),
slopes AS (SELECT m.category, any_value(n) AS n, any_value(first_step) AS first_step, any_value(last_step) AS last_step,
                  1000 * sum((s.step - mx) * (s.reward - my)) / sum((s.step - mx) * (s.step - mx)) AS slope
           FROM sums m JOIN scored s ON m.category IS NULL OR m.category = s.category GROUP BY m.category)
SELECT category, n, first_step, last_step, (round(slope, 6) + 0.0) AS slope_per_1000_steps, slope >= 0.1 AS meets_target FROM slopes""",
    "completion_lengths": with_(ROLLOUTS) + """
, c AS (SELECT length(coalesce(completion, '')) AS chars FROM rollouts),
h AS (SELECT chars, count(*) AS cnt FROM c GROUP BY chars),
hc AS (SELECT chars, sum(cnt) OVER (ORDER BY chars ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              sum(cnt) OVER () AS n FROM h),
q AS (SELECT min(CASE WHEN cum >= ceil(n * 0.5) THEN chars END) / 4.0 AS p50_tokens,
             min(CASE WHEN cum >= ceil(n * 0.9) THEN chars END) / 4.0 AS p90_tokens FROM hc)
SELECT count(*) AS n, (round(min(chars) / 4.0, 6) + 0.0) AS min_tokens, (round(avg(chars / 4.0), 6) + 0.0) AS mean_tokens,
       (round(max(chars) / 4.0, 6) + 0.0) AS max_tokens,
       count(*) FILTER (WHERE chars / 4.0 >= 20 AND chars / 4.0 <= 60) AS n_in_target,
       count(*) FILTER (WHERE chars / 4.0 >= 256) AS n_at_cap,
       (round(any_value(q.p50_tokens), 6) + 0.0) AS p50_tokens, (round(any_value(q.p90_tokens), 6) + 0.0) AS p90_tokens
FROM c, q""",
    "reward_by_category": ALL + """
SELECT category, count(*) AS n, (round(avg(reward), 6) + 0.0) AS mean_reward, (round(stddev_samp(reward), 6) + 0.0) AS reward_std,
       (round(min(reward), 6) + 0.0) AS min_reward, (round(max(reward), 6) + 0.0) AS max_reward,
       (round(avg(reward_raw), 6) + 0.0) AS mean_reward_raw, count(*) FILTER (WHERE penalty > 0) AS n_penalised,
       count(*) FILTER (WHERE json_state = 'object') AS n_json
FROM scored GROUP BY ROLLUP (category)""",
    "completion_sample": with_(ROLLOUTS) + """
, f AS (SELECT step, min(rollout_id) AS rollout_id, arg_min(completion, rollout_id) AS completion FROM rollouts GROUP BY step)
SELECT step, rollout_id, substr(completion, 1, 200) AS sample FROM f WHERE length(completion) > 100""",
}
# the same rows by another way
ORACLE["completion_parse_messages"] = ORACLE["completion_parse_stored"] = ORACLE["completion_parse"]
ORACLE["completion_lists_stored"] = ORACLE["completion_lists"]
ORACLE["reward_all_stored"] = ORACLE["reward_all"]
ORACLE["position_lookup_indexed"] = ORACLE["position_lookup"]
ORACLE["reward_all_indexed"] = ORACLE["reward_all"]
ORACLE["token_rows_by_turn"] = ORACLE["token_rows_masked"]
for _name in ("reward_advantage", "reward_final_score", "reward_last_move"):
    ORACLE[f"{_name}_sql"] = ORACLE[_name]
# the error bound is a property of the sketches: within it every time
ORACLE["length_sketch_quantiles"] = with_(RECORDS, PROMPTS, ROLLOUTS) + """
SELECT category, n, CAST(p AS DOUBLE) AS p, true AS within_bound FROM (
  SELECT coalesce(p.category, '') AS category, count(*) AS n FROM rollouts r LEFT JOIN prompts p ON p.record_id = r.prompt_id GROUP BY 1),
  (SELECT unnest([0.1, 0.5, 0.9, 0.99]) AS p)"""
