"""DuckDB SQL for the queries that SQL can express."""

_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(text, '{_ABC}', '{_ABC.lower()}')"

DECONTAMINATION = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT item_id, w[s:s + 9] AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT rid, s, n, w[s:s + n - 1] AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
), found AS (
  SELECT DISTINCT rid, s, doc_windows.n, item_id FROM doc_windows JOIN item_windows USING (win)
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM found) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""

SUBSTRING = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT rid, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS win
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)
), earliest AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
gone AS (
  SELECT DISTINCT rid, unnest(range(s, s + 50)) AS p FROM windows JOIN earliest USING (win) WHERE doc_id > least
), words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid
), removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid)
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(length('<s></s>') + 2 + length(role) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\])'))
                + CASE WHEN role = 'user' THEN length('[INST] ') + length(' [/INST]') ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4 FROM d
), p AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r3 >= 50 THEN 'plain'
                 WHEN r4 < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS pre,
         coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS mid,
         coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS suf FROM c
)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

DIVERGENCE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOWER.replace('text', "coalesce(text, '')", 1)}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), words AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
terms AS (SELECT lang, term, count(*) AS lang_cnt FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v, coalesce(sum(lang_cnt), 0)::HUGEINT AS lang_n FROM (SELECT DISTINCT lang FROM d) LEFT JOIN terms USING (lang) GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS cnt FROM words GROUP BY ALL),
cells AS (
  SELECT g.lang, g.source, t.term, coalesce(f.cnt, 0) AS cnt, t.lang_cnt
  FROM groups g JOIN terms t USING (lang) LEFT JOIN found f ON f.lang = g.lang AND f.source = g.source AND f.term = t.term
), sized AS (SELECT *, sum(cnt) OVER (PARTITION BY lang, source)::HUGEINT AS n FROM cells),
shares AS (
  SELECT lang, source, term, cnt, 1 + (1000000000::HUGEINT * (cnt + 2)) // (n + 2 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_cnt + 2)) // (lang_n + 2 * v) AS q FROM sized JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), marking AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE cnt > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM marking
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

SQL: dict[str, str] = {
    "op1_benchmark_decontamination": DECONTAMINATION,
    "op2_substring_dedup": SUBSTRING,
    "op7_chat_template": CHAT,
    "op12_fill_in_middle": FILL_IN_MIDDLE,
    "op13_source_divergence": DIVERGENCE,
}
