"""Each operator against a plain brute-force version, and its defined cases:
nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from rollout_tables.llm import ann, chat, common, decontaminate, entities, gbt, lm, pieces, pii, quality, simhash, substring, template, toxicity
from rollout_tables.llm.fmindex import FMIndex, suffix_array
from rollout_tables.llm.oracle import SQL

SF001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
WIDE = DOCS + ", lang string, source string, n_chars long, score double, n_words string, fp string"
RNG = random.Random(5)
VOCAB = ["ab", "cd", "Ef", "gh,", "ij", "été", "kl.", "mn", "日本", "x1"]


def prose(n, vocab=VOCAB, rng=RNG):
    return " ".join(rng.choice(vocab) for _ in range(n))


def awkward(extra=()):
    """Null, empty, blank, long, tied and repeated rows."""
    shared = prose(70)
    rows = [(1, shared), (2, shared), (2, shared), (3, shared + " tail"), (4, None), (5, ""), (6, " \n\t "), (None, shared), (None, None), (7, "one"), (8, prose(3000)), (9, "x" * 5000), (10, "lead " + shared), (7, "other"), (11, prose(60) + " " + shared), *extra]
    return rows


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 0.5, "w", "f") for i, t in rows], WIDE)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- 1 benchmark decontamination ---------------------------------------------

def test_suffix_array_and_fm_index_against_naive_search():
    rng = np.random.default_rng(1)
    for _ in range(40):
        parts = [rng.integers(1, 4, rng.integers(1, 30)).tolist() for _ in range(rng.integers(1, 6))]
        text = np.array([x for p in [*parts, parts[0]] for x in [*p, 0]])
        order = suffix_array(text)
        assert sorted(order.tolist()) == list(range(len(text)))
        index = FMIndex(text, 3)
        patterns = np.zeros((30, 6), np.int64)
        lengths = rng.integers(1, 7, 30)
        for k, n in enumerate(lengths):
            patterns[k, :n] = rng.integers(1, 4, n)
        lo, hi = index.find(patterns, lengths)
        for p, n, a, b in zip(patterns, lengths, lo, hi):
            want = [i for i in range(len(text)) if text[i:i + n].tolist() == p[:n].tolist()]
            assert sorted(index.locate(np.arange(a, b)).tolist() if b > a else []) == want


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[s:s + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        names = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((doc, len(w), len(hit), len([i for i in found if i is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [1_000_000, 5])
def test_decontamination(spark, monkeypatch, block_words, tmp_dir):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rows = awkward()
    passage = " ".join(rows[0][1].split()[5:30])
    items = [(1, passage), (1, passage), (2, passage.upper()), (None, "one"), (3, "x1 mn"), (4, None), (5, ""), (6, "nowhere to be found"), (12, passage + " more")]
    docs_of(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert rows_of(decontaminate.query(spark, tmp_dir)) == contamination(rows, items)
    clean = decontaminate.remove_spans(wide(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == wide(spark, rows).columns and clean.count() == len(rows)
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    if block_words > 5:
        assert not any(r[2] for r in contamination(kept, items))
    assert sorted((t for i, t in kept if i in (4, 5, 6, 9)), key=repr) == sorted((t for i, t in rows if i in (4, 5, 6, 9)), key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) or r.text == dict(rows).get(r.doc_id) for r in clean.collect())


def test_cutting_does_not_depend_on_the_blocks(spark, monkeypatch):
    w = [f"w{k}" for k in range(40)]
    # item 2 overlaps a span of item 1; a cut for item 3 brings item 4's words together
    items = [(1, " ".join(w[0:12])), (2, " ".join(w[6:20])), (3, " ".join(w[20:30])), (4, " ".join(w[30:40]))]
    rows = [(1, "lead " + " ".join(w[0:20]) + " tail"), (2, " ".join([*w[30:35], *w[20:30], *w[35:40], "end"])), (3, None), (4, "clean"), (2, " ".join([*w[30:35], *w[20:30], *w[35:40], "end"]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for block_words in (1_000_000, 5):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
        cleaned = decontaminate.remove_spans(wide(spark, rows), benchmark)
        assert cleaned.columns == wide(spark, rows).columns
        got.append(rows_of(cleaned))
        assert not any(r[2] for r in contamination([(r[0], r[1]) for r in got[-1]], items))
    assert got[0] == got[1] and [r[1].split() for r in got[0] if r[0] == 1] == [["lead", "tail"]]


# --- 2 substring dedup --------------------------------------------------------

def substrings(docs, size=50):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first = {}
    for d, w in split:
        for s in range(len(w) - size + 1 if d is not None else 0):
            k = tuple(w[s:s + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for s in range(len(w) - size + 1 if d is not None else 0):
            if first[tuple(w[s:s + size])] < d:
                gone.update(range(s, s + size))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rng = random.Random(3)
    passages = [prose(n, rng=rng) for n in (49, 50, 51, 90, 200)]
    rows = awkward([(100 + k, " ".join(rng.choice([*passages, prose(rng.randint(1, 40), rng=rng)]) for _ in range(4))) for k in range(60)])
    assert rows_of(substring.substring_dedup(wide(spark, rows))) == substrings(rows)
    assert rows_of(substring.substring_dedup(docs_of(spark, rows), window=8, seed=4)) == substrings(rows, 8)


# --- 3 PII -----------------------------------------------------------------------

PRIVATE = "mail Jo.Doe+x@Mail7.example.com or +1 (017) 555-7713, ip 97.51.17.173, card 4111 1111 1111 1111, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\", Mrs. Anna Smith and Госпожа Анна Петрова"


def test_surrogates_are_consistent_distinct_and_typed(spark):
    rows = [(1, PRIVATE), (2, "again 4111-1111-1111-1111 for Mrs. Anna Smith. v1.2.3.4.5 and 1234567890123456 stay"), (3, None), (4, ""), (None, PRIVATE), (1, PRIVATE)]
    rows += [(100 + k, f"u{k}@a.example.com 10.0.{k % 256}.{k // 256 + 1}") for k in range(600)]
    got = pii.replace_entities(wide(spark, rows), counted=True).collect()
    assert len(got) == len(rows)
    new, old = {}, {}
    by_text = {}
    for r in got:
        by_text.setdefault(r.doc_id, []).append(r.text)
        assert r.n_chars is None if r.text is None else r.n_chars == len(r.text)
    assert by_text[3] == [None] and by_text[4] == [""]
    assert "1234567890123456 stay" in by_text[2][0] and "v1.2.3.4.5" in by_text[2][0]
    assert len({*by_text[1], *by_text[None]}) == 1
    for i, text in rows:
        for a, b in zip(entities.detect(text or ""), entities.detect(by_text[i][0] or ""), strict=True):
            assert a[2] == b[2]
            new.setdefault((a[2], a[3]), set()).add(b[3])
            old.setdefault((b[2], b[3]), set()).add(a[3])
            if a[2] == "card":
                assert entities.luhn(b[3])
            if a[2] == "name":
                assert a[3].split("|")[:2] == b[3].split("|")[:2]
    assert all(len(v) == 1 for v in new.values()) and all(len(v) == 1 for v in old.values())
    assert not set(new) & set(old)
    assert re.search(r"card \d{4} \d{4} \d{4} \d{4},", by_text[1][0]) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", by_text[1][0])


def test_surrogate_collisions_are_drawn_again(spark, monkeypatch):
    def few(key, kind, identity, attempt):
        return "abcdefgh"[(int(identity[1:]) + attempt * (int(identity[1:]) + 1)) % 8]
    monkeypatch.setattr(entities, "surrogate", few)
    found = spark.createDataFrame([(f"secret:x{k}",) for k in range(5)], "entity string")
    table = pii.surrogate_table(found).collect()
    assert len({r.surrogate for r in table}) == 5 == len({r.entity for r in table})


@pytest.mark.parametrize("written,kind", [(x, "phone") for x in ["+15551234567", "+49 30 1234567", "+33 6 12 34 56 78", "+44 7911 123456", "(555) 123-4567", "555-123-4567", "+1 (017) 555-7713", "0049 30 1234567", "030 1234567", "555.123.4567", "1-800-555-0199", "07911123456", "5551234567", "555-1234", "+49 (0)30 1234567"]]
                         + [(x, "card") for x in ["4111 1111 1111 1111", "378282246310005", "3782 822463 10005", "4222222222222", "6304-0000-0000-0000-000"]])
def test_number_shapes_are_detected(written, kind):
    for text in (f"call {written} now", written, f"({written}), 2024-01-15", f"x: {written}."):
        assert [text[a:b] for a, b, k, _ in entities.detect(text) if k == kind] == [written]
        assert len(entities.detect(text)) == 1


@pytest.mark.parametrize("text", ["2024-01-15 10:30", "15.01.2024", "1999-2004", "3.14159265", "1.234.567", "v1.2.3.4.5", "1234567890123456", "id 12345678", "monkey: abcdefgh", "key: a plain sentence", "key = some_long_function_name_here(x)"])
def test_other_numbers_stay(text):
    assert entities.detect(text) == []


@pytest.mark.parametrize("text", ["API_KEY=%s", "key: %s", "AWS_SECRET=%s;", '"api_key": "%s"', "token = '%s'"])
def test_secrets_need_no_quotes(text):
    for value in ("04dbebab91ab85687d33eeaaf9ac699e1188f962", "sk_Live_51Habcdefghijklmnopq-xyz"):
        assert [(k, i) for _, _, k, i in entities.detect(text % value)] == [("secret", value)]


def test_mentions_of_a_person_are_linked(spark):
    rows = [(1, "Mr John Smith came. Mr Smith sat; Smith said so, John Smith too. Smithson stays"), (2, "Dr Anna Kim, later Mrs Anna Kim and Mrs. Kim"), (3, "Mr Smith of another text"), (4, "Smith without a title")]
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.replace_entities(docs_of(spark, rows), counted=True).collect()}
    given, family = got[1][0].split()[1:3]
    assert got[1] == (f"Mr {given} {family} came. Mr {family} sat; {family} said so, {given} {family} too. Smithson stays", 4) and {given, family}.isdisjoint({"John", "Smith"})
    assert got[3][0] == f"Mr {family} of another text" and got[4] == (rows[3][1], 0)
    anna, kim = got[2][0].rstrip().split()[1], got[2][0].split()[-1]
    assert got[2] == (f"Dr {anna} {kim}, later Mrs {anna} {kim} and Mrs. {kim}", 3) and anna in entities.GIVEN["latin", "f"] + [anna] and anna != "Anna"


def test_shapes_that_fill_their_pool_settle(spark):
    hexadecimal = [f"email:{a}@{b}.com" for a in "abcdef" for b in "abcdef"]
    found = hexadecimal + [f"email:{k}@{j}.com" for k in "_-" for j in range(10)] + ["secret:" + "-" * 24] + [f"name:f|latin|{n}" for n in entities.GIVEN["latin", "f"]]
    found += [f"name:f|latin|Nn{chr(97 + k)}" for k in range(20)] + [f"ipv4:192.168.{a}.{b}" for a in range(0, 256) for b in range(1, 141)]
    table = pii.surrogate_table(spark.createDataFrame([(e,) for e in found], "entity string")).collect()
    new = {r.surrogate for r in table}
    assert len(table) == len(set(found)) == len(new) and new.isdisjoint(found)


# --- 4 quality, 10 toxicity ---------------------------------------------------------

def labelled(spark, n=240):
    rng = random.Random(9)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "vita"]
    docs, labels = [], []
    for k in range(n):
        bad, toxic = k % 5 == 0, k % 4 == 1
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if toxic:
            w[len(w) // 2] = rng.choice(["vilefoo", "vilebar"])
        text = "!! ".join(x.upper() for x in w) if bad else ". ".join(" ".join(w[i:i + 8]) for i in range(0, len(w), 8))
        docs.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(None, 1, 0), (3, None, None), (99999, 1, 1)]
    return [*docs, (None, "x"), (1000, None), (1001, ""), (0, "again")], spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize("module,which,folds,held", [(quality, 0, 3, 1), (toxicity, 1, 5, 0)])
def test_classifiers(spark, tmp_dir, module, which, folds, held):
    rows, labels, truth = labelled(spark)
    wide(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    got = module.query(spark, tmp_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == held)
    right = [r.predicted == truth[r.doc_id][which] for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id][which] is not None and r.doc_id]
    assert len(right) > 20 and np.mean(right) > 0.95


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_documents(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(spark, awkward())
    assert module.score(docs, module.fit(docs, none)).count() == len(awkward())
    empty = docs_of(spark, [])
    assert module.score(empty, module.fit(empty, none)).count() == 0


def test_held_out_labels_do_not_matter(spark):
    rows, labels, _ = labelled(spark)
    docs = docs_of(spark, rows)
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    a, b = (quality.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.threshold, b.threshold) and np.array_equal(a.value, b.value)


def test_offending_sentences_are_located(spark):
    rows, labels, _ = labelled(spark)
    docs = docs_of(spark, rows)
    text = "lorem ipsum dolor. sit été vilefoo amet! magna vita"
    found = toxicity.score(docs_of(spark, [(1, text)]), toxicity.fit(docs, labels)).head().offending
    assert [text.encode()[s["first"]:s["end"]].decode() for s in found] == ["sit été vilefoo amet"]


def test_trees_learn_a_threshold_and_survive_constants():
    x = np.c_[np.arange(400.0), np.zeros(400)]
    y = (x[:, 0] > 150).astype(float)
    assert ((gbt.fit(x, y).probability(x) >= 0.5) == y).mean() > 0.98
    assert np.allclose(gbt.fit(x, np.ones(400)).probability(x), 401 / 402)


# --- 5 pieces -----------------------------------------------------------------------

ODD = ["", " ", " a", "a ", "  Hello  wörld\n\tx é😀 ", "y" * 300, " " * 100, "日本語 テキスト", "<s></s> <0x41>", "\u0000 \r\n", "    def f(x):\n        return x, 'a'", "!!!!???? ......", "naïve|co-op|(a)", "ab " * 50, None]


def test_pieces_equal_the_library(spark):
    raw = pieces.load()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ODD + [t for t, in duckdb.sql(f"select text from '{SF001}/documents.parquet'").fetchall()]
    got = {r.doc_id: r for r in pieces.encode(wide(spark, list(enumerate(texts))), raw).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k].token_ids == library.encode(text or "") and got[k].n_tokens == len(got[k].token_ids)
        assert got[k].decoded == (text or "") == library.decode(got[k].token_ids)


def test_unigram_models_take_the_path_of_best_score():
    raw = pieces.load().replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01")
    machine = pieces.Machine(raw)
    assert not machine.bpe
    rng = random.Random(1)
    for text in ["the", "quick", "wörld", "日x", *("".join(rng.choice("etaoinshr") for _ in range(7)) for _ in range(20))]:
        word = machine.normalise(text)
        ids = np.frombuffer(machine.encode(text), np.int32).tolist()
        assert machine.decode(ids) == text
        best = None
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts = "".join(c + "\n" * k for c, k in zip(word, [*cuts, 0])).split("\n")
            if all(x in machine.score or len(x) == 1 for x in parts):
                best = max(best or -np.inf, sum(machine.score.get(x, machine.worst) for x in parts))
        by_id = {k: machine.score[x] for x, k in machine.ids.items()}
        if all(k in by_id for k in ids):
            assert sum(by_id[k] for k in ids) == best


# --- 6 nearest neighbours -------------------------------------------------------------

def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (900, 12)) * rng.uniform(0.5, 2, (900, 1))
    x[300:420] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(20_000, None), (None, rows[0][1]), (20_020, [0.0] * 12), (20_040, [float("nan")] + [1.0] * 11), (20_060, [None] + [1.0] * 11), (20_080, [1.0] * 11), (20_100, [float("inf")] * 12), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(scores[i] - s) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9


def test_neighbours_of_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert ann.nearest(few.filter("vec_id < 0")).count() == 0


# --- 7 chat ---------------------------------------------------------------------------

TURNS = [(1, 1, "assistant", "b\n</s>"), (1, 0, "user", "<\\/s> a [INST][/INST] \\<s>"), (1, 1, "assistant", "b\n</s>"), (2, 0, None, None), (2, None, "assistant", ""), (None, 0, "sys\ntem\\n", "x [\\\\INST]"), (None, 1, "user", " [/INST]"), (3, 0, "assistant", "é😀" * 400)]


def test_chat_digests_equal_sql(spark, tmp_dir):
    df = spark.createDataFrame([(*t, "r", 1) for t in TURNS if t[2] != "sys\ntem\\n"], "conv_id long, turn long, role string, text string, formatted string, part int")
    df.write.parquet(f"{tmp_dir}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_dir}/conversations.parquet/*.parquet'")
    want = con.execute(SQL["op7_chat_template"])
    names = [c[0] for c in want.description]
    got = chat.query(spark, tmp_dir).select(*names)
    assert rows_of(got) == sorted(map(tuple, want.fetchall()), key=repr)


def test_chat_round_trip_and_empty_table(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    texts = {}
    for r in chat.format_conversations(df).collect():
        texts.setdefault(r.conv_id, []).append(r.formatted)
    for conv, parts in texts.items():
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] is not None, t[2] or "", t[3] or ""))
        assert list(chat.read_turns(parts)) == [(t[2] or "", t[3] or "") for t in own]
    assert chat.format_conversations(df.filter("conv_id = 77")).count() == 0


def test_template_language():
    source = "{% set x = 'a' ~ 'b' %}{{ x }}{% if 1 == 2 %}no{% elif not true %}no{% else %}yes{% endif %}{% for m in messages %}{{ loop.index }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}{# c #}{%- if x in 'zabz' and x != 'q' or false %} {{ 1 + 2 }}{% endif %}"
    assert "".join(p[0] for p in template.compile_template(source)([{"t": "q"}, {"t": "r"}])) == "abyes1q,2r 3"
    assert template.fold(template.parse("a{{ 'b' ~ 1 }}{% if false %}x{% endif %}"), {}) == ("block", [("constant", "ab1")])
    for wrong in ("{{ a.b( }}", "{% for x in y %}{% endfor %}", "{% if a %}", "{{ ''|nofilter }}", "{% endif %}", "{{ x() }}", "{{ x[0] }}"):
        with pytest.raises(template.TemplateError):
            template.compile_template(wrong)
    leak = template.compile_template("{{ x.__class__ }}{{ x.upper }}")
    assert "".join(p[0] for p in leak((), x="text")) == ""


# --- 8 language model -------------------------------------------------------------------

def test_language_model(spark):
    rng = random.Random(4)
    chain = ["the", "cat", "sat", "on", "a", "mat"]
    rows = [(200 + k, " ".join(chain * 30)) for k in range(20)] + [(100, " ".join(rng.sample(chain * 30, 180))), *awkward()]
    docs = wide(spark, rows)
    words = lm.vocabulary(docs)
    weights = lm.train(docs, words)
    got = lm.score(docs, words, weights).collect()
    assert len(got) == len(rows) and all(r.log_likelihood == 0 for r in got if r.n_tokens == 0)
    assert all(r.n_tokens == len(words_of(dict(rows)[r.doc_id])) for r in got if r.doc_id and r.doc_id != 7)
    mean = {r.doc_id: r.log_likelihood / r.n_tokens for r in got if r.n_tokens}
    assert mean[200] > mean[100] > -np.log(lm.VOCABULARY) - 1
    empty = docs.filter("doc_id = -5")
    assert lm.score(empty, lm.vocabulary(empty), lm.train(empty, lm.vocabulary(empty))).count() == 0


def test_language_model_is_normalised_and_sees_no_target():
    rng = np.random.default_rng(0)
    weights = [w.astype(float) + rng.normal(0, 0.1, w.shape) for w in lm.start_weights()]
    ids, first = rng.integers(0, lm.VOCABULARY, 30), np.array([0, 11, 11, 30])
    around = lm.contexts(ids, first, np.arange(30))
    everything = lm.forward(weights, np.repeat(around[5:6], lm.VOCABULARY, axis=0), np.arange(lm.VOCABULARY))[0]
    assert abs(np.exp(everything).sum() - 1) < 1e-9
    other = ids.copy()
    other[5] = (ids[5] + 1) % lm.VOCABULARY
    assert np.array_equal(lm.contexts(other, first, np.arange(30))[5], around[5])
    assert around[0].tolist()[:2] == [lm.VOCABULARY] * 2 and around[10].tolist()[2:] == [lm.VOCABULARY] * 2


def test_every_place_is_a_training_target_once():
    first = np.array([0, 5, 5, 12, 13])
    for rounds in (1, 2, 3):
        assert sorted(np.concatenate([lm.places_of(first, t, rounds) for t in range(rounds)]).tolist()) == list(range(13))


def test_a_fixed_successor_is_learned(spark):
    # of every pair of a word and its only successor both are predicted, whatever they hash to
    pairs = [(f"left{k}", f"right{k}") for k in range(12)]
    docs = docs_of(spark, [(n, " ".join(f"{a} {b}" for a, b in random.Random(n).sample(pairs, 12))) for n in range(4000)])
    words = lm.vocabulary(docs)
    weights = lm.train(docs.coalesce(1), words)
    for a, b in pairs:
        logs = {r.doc_id: r.log_likelihood for r in lm.score(docs_of(spark, [(0, f"{a} {b}"), (1, f"{b} {a}")]), words, weights).collect()}
        assert logs[0] > -2 * np.log(lm.CLASSES)


def test_vocabulary_follows_the_corpus_and_words_have_scores_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(lm, "NAMED", 20)
    monkeypatch.setattr(lm, "BUCKET_WORDS", 40)
    rows = [(k, " ".join(f"w{(k * 7 + j) % 300}" for j in range(60)) + f" once{k}") for k in range(60)]
    docs = docs_of(spark, rows)
    words = lm.vocabulary(docs)
    assert len(words["known"]) == 300 and words["token"].max() <= 20 + 7
    for token in np.unique(words["token"]):
        assert abs(np.exp(words["within"][words["token"] == token]).sum() - 1) < 1e-9
    weights = lm.train(docs, words)
    tail = ["w5", "w155", "w298", "once3", "unseen", "qzxqj", "été", "x" * 400]
    got = [r.log_likelihood for r in lm.score(docs_of(spark, [(0, f"w1 {t} w2") for t in tail]), words, weights).collect()]
    assert len(set(got)) == len(tail) and got[3] > got[5] > got[7]
    few = lm.vocabulary(docs.filter("doc_id < 10"))
    assert len(few["known"]) < len(words["known"])


def test_spellings_are_a_distribution():
    data = np.frombuffer(b"abcabdab", np.uint8)
    codes, _ = lm._trigrams(data, np.array([0, 3, 6]), np.array([3, 6, 8]))
    model = lm.spelling(*np.unique(codes, return_counts=True))
    for context in (b"", b"a", b"ab", b"zz"):
        raw = np.frombuffer(b"".join(context + bytes([c]) for c in range(256)) + context, np.uint8)
        size = len(context) + 1
        starts = np.arange(0, 257 * size, size)
        codes, first = lm._trigrams(raw, starts, np.minimum(starts + size, len(raw)))
        at = np.r_[first[:-1] + size - 1, first[-1] + size - 1]
        asked = codes[at]
        hit = np.searchsorted(model["codes"], asked).clip(0, len(model["codes"]) - 1)
        logs = np.where(model["codes"][hit] == asked, model["seen"][hit], model["share"][asked // lm.SYMBOLS] + model["two"][asked % lm.SYMBOLS ** 2])
        assert asked[-1] % lm.SYMBOLS == lm.END and abs(np.exp(logs).sum() - 1) < 1e-9


# --- 9 SimHash ---------------------------------------------------------------------------

def simple_fingerprint(text, k=3):
    data = (text or "").encode().lower().split()
    grams = [b" ".join(data[i:i + k]) for i in range(len(data) - k + 1)] or ([b" ".join(data)] if data else [])
    bits = 0
    for b in range(64):
        bits |= (sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) * 2 > len(grams)) << b
    return bits


def simple_components(pairs):
    ids, prints = zip(*pairs)
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(pairs)), key=repr)


def test_simhash(spark, tmp_dir, monkeypatch):
    base = prose(90).split()
    near = [(200 + k, " ".join(base[:k] + ["edit"] + base[k + 1:])) for k in range(0, 90, 3)]
    rows = awkward(near)
    wide(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    want = simple_components([(i, simple_fingerprint(t)) for i, t in rows])
    assert rows_of(simhash.query(spark, tmp_dir)) == want
    monkeypatch.setattr(simhash, "PIECE_BYTES", 50)
    assert all(int.from_bytes(simhash.fingerprint(t), "big") == simple_fingerprint(t) for _, t in rows)
    kept = simhash.keep_one(wide(spark, rows))
    assert kept.columns == wide(spark, rows).columns
    numbered = simple_components([(k, simple_fingerprint(t)) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, _, c in numbered:
        groups.setdefault(c, []).append(rows[k])
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(found) == len(groups)
    assert sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()), key=repr) == sorted((d for d, _ in found), key=repr)


@pytest.mark.parametrize("most", [simhash.BUCKET_PAIRS, 40, 3000])
def test_links_and_components_of_near_fingerprints(spark, monkeypatch, most):
    """Also where buckets are split by the halves of the other segment."""
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", most)
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    prints = sorted(prints)
    as_long = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in as_long], "fp long"))
    assert edges.count() < (8 if most > 1 << 20 else 50) * len(prints)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    want = simple_components(list(zip(range(len(prints)), prints)))
    groups, names = {}, {}
    for (k, _, c), p in zip(sorted(want), as_long):
        groups.setdefault(c, set()).add(root.get(p, p))
        names.setdefault(root.get(p, p), set()).add(c)
    assert all(len(g) == 1 for g in groups.values()) and all(len(n) == 1 for n in names.values())


def test_a_bucket_over_several_batches_is_found_large(spark, monkeypatch):
    """5,000 fingerprints that share a segment: none is lost, whether their
    bucket is worked on whole or posted again."""
    rng = random.Random(9)
    low = rng.getrandbits(32)
    prints = {(rng.getrandbits(32) << 32) | low for _ in range(2400)}
    prints |= {p ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(64)) for p in list(prints)}
    as_long = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(5)
    whole = rows_of(simhash.components(simhash.links(as_long)))
    assert len(whole) >= len(prints) // 2 - 10  # all but the roots
    met = []
    inner = simhash._meet
    monkeypatch.setattr(simhash, "_meet", lambda posts, bits, most: met.append(most) or inner(posts, bits, most))
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", 1 << 18)
    assert rows_of(simhash.components(simhash.links(as_long))) == whole and met == [1 << 18, None]


# --- empty tables, and the pipeline --------------------------------------------------------

def test_empty_documents(spark):
    empty = wide(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.hits(empty, items).count() == decontaminate.remove_spans(empty, items).count() == 0
    assert substring.substring_dedup(empty).count() == 0
    assert pii.replace_entities(empty).columns == empty.columns
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0
    assert pieces.encode(empty, pieces.load()).count() == 0
    assert decontaminate.hits(docs_of(spark, awkward()), items).filter("size(spans) > 0").count() == 0


def test_chunks_hold_whole_rows():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", None, "b" * 50, "", "cc", "dddd"])], ["text"])
    parts = [p.column(0).to_pylist() for p in common.chunks(batch, limit=6)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert all(sum(len(t or "") for t in p) <= 6 or len(p) == 1 for p in parts)


def test_pipeline_stages(spark, tmp_dir):
    rows, labels, _ = labelled(spark)
    passage = " ".join(f"item{k}" for k in range(12))
    good = ". ".join(["lorem ipsum dolor sit amet magna vita lorem"] * 6)
    rows += [(3000, good + " " + passage + " end"), (3001, good + " write to who@mail1.example.com soon"), (3002, rows[1][1]), (3003, None)]
    wide(spark, rows).write.parquet(f"{tmp_dir}/documents.parquet")
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    columns, text_after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.scratch(stage(spark, docs, tmp_dir), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_classifier":
            trees = quality.fit(before, labels)
            want = {(r.doc_id, r.score >= 0.5) for r in quality.score(before, trees).collect()}
            assert rows_of(docs.select("doc_id", "text")) == sorted(((r.doc_id, r.text) for r, s in zip(before.collect(), quality.score(before, trees).collect()) if s.score >= 0.5), key=repr) and want
        if name == "simhash_dedup":
            groups = simple_components([(r.doc_id, simple_fingerprint(r.text)) for r in before.collect()])
            assert sorted((r.doc_id for r in docs.collect()), key=repr) == sorted({c for _, _, c in groups}, key=repr)
        text_after[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any("item3" in (t or "") for t in text_after["benchmark_decontamination"].values())
    assert not any("who@mail1" in (t or "") for t in text_after["pii_surrogates"].values())
    assert docs.filter("decoded <> coalesce(text, '')").count() == 0
    assert rows_of(corpus_pipeline.run(spark, tmp_dir).select("doc_id", "token_ids")) == rows_of(docs.select("doc_id", "token_ids"))


# --- words that a polynomial hash takes for one -------------------------------

def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_different_long_words_stay_different_in_op1_and_op2(spark):
    one, other = thue_morse(10)
    words = prose(80, ["k1", "k2", "k3", "k4", "k5", "k6"], random.Random(1)).split()
    twin = [*words[:30], one, *words[30:]]
    rows = [(1, " ".join(twin)), (2, " ".join(w if w != one else other for w in twin)), (3, " ".join([other] * 60)), (4, " ".join([one] * 60)), (5, " ".join([one] * 60))]
    docs = docs_of(spark, rows)
    bench = spark.createDataFrame([(10, " ".join(twin[25:35]))], "item_id long, text string")
    got = {r["doc_id"]: len(r["items"]) for r in decontaminate.hits(docs, bench).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}
    removed = {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(docs).collect()}
    # document 2 shares its last 50 words with 1, and no window with the changed word
    assert removed == {1: 0, 2: 50, 3: 0, 4: 0, 5: 60}


def test_words_of_one_hash_are_told_apart_by_their_bytes(spark, monkeypatch):
    def weak(data, offsets, is_word, lower, salt=0):
        data = common.LOWER[data] if lower else data
        starts, ends, first = common.split_words(data, offsets, is_word)
        return (ends - starts).astype(np.uint64), starts, ends, first
    monkeypatch.setattr(decontaminate, "word_hashes", weak)  # the length for a hash
    block = decontaminate._block([(1, "aa bbb cccc d")], 3)
    texts = ["aa bbb cccc", "xx bbb cccc d", "zz yyy cccc d", "AA BBB CCCC D"]
    data, offsets = common.utf8(pa.array(texts))
    s, _, _, _, _, first = decontaminate.occurrences(data, offsets, block)
    assert sorted(np.searchsorted(first[1:], s, side="right").tolist()) == [0, 1, 3, 3]


# --- 6: inverted files of truncated permutations -----------------------------

def test_files_hold_each_vector_under_its_nearest_pivots_only():
    rng = np.random.default_rng(4)
    x, pivots = rng.normal(size=(300, 8)), rng.normal(size=(40, 8))
    prefixes = ann.nearest_pivots(x, pivots, 6)
    whole = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
    assert (prefixes == whole[:, :6]).all() and (ann.nearest_pivots(x, pivots, 99) == whole).all()
    begin, rows, places = ann.inverted_files(prefixes, 40)
    for p in range(40):
        got = dict(zip(rows[begin[p]:begin[p + 1]], places[begin[p]:begin[p + 1]]))
        assert got == {i: prefixes[i].tolist().index(p) for i in range(300) if p in prefixes[i]}


def test_shared_places_rank_as_the_footrule_does(monkeypatch):
    rng = np.random.default_rng(5)
    x, pivots, q = rng.normal(size=(200, 6)), rng.normal(size=(30, 6)), rng.normal(size=(1, 6))
    n = 10
    prefixes, asked = ann.nearest_pivots(x, pivots, n), ann.nearest_pivots(q, pivots, n)

    def footrule(a, b):  # a pivot that one lacks stands just behind its end
        place = lambda seq, p: list(seq).index(p) if p in seq else n
        return sum(abs(place(a, p) - place(b, p)) for p in {*a, *b})
    distance = np.array([footrule(p, asked[0]) for p in prefixes])
    monkeypatch.setattr(ann, "SHARE", 0.1)
    monkeypatch.setattr(ann, "RERANKED", 1)
    _, found, _ = ann.search_shard(np.arange(200), x, prefixes, 30, np.array([7]), q, asked, 20)
    assert sorted(distance[found])[-1] <= sorted(distance)[19]


@pytest.mark.parametrize("shard_rows", [400, 100000])
def test_recall_by_shard_size_and_not_by_cores(spark, monkeypatch, shard_rows):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(ann, "RERANKED", 8)
    hits = 0
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    best = {i: set(np.argsort(-score[i])[:20].tolist()) for i in range(0, 4000, 20)}
    for r in ann.nearest(df).collect():
        hits += r["vec_id"] in best[r["query_id"]]
    assert hits / (20 * len(best)) >= 0.9


# --- 8: one result in any layout, and a plain scorer ---------------------------

def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 4000)  # several trainers
    rng = random.Random(9)
    rows = [(k, prose(rng.randrange(60), VOCAB + ["the", "of"], rng)) for k in range(300)] + [(1, "twice"), (1, "twice"), (None, None)]
    scores = []
    for parts in (1, 8):
        docs = docs_of(spark, rows).repartition(parts)
        words = lm.vocabulary(docs)
        got = lm.score(docs, words, lm.train(docs, words)).collect()
        scores.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["log_likelihood"]) for r in got))
    assert [x[:3] for x in scores[0]] == [x[:3] for x in scores[1]]
    assert np.allclose([x[3] for x in scores[0]], [x[3] for x in scores[1]], rtol=1e-5)


def test_scores_equal_a_plain_loop_over_words(spark):
    rng = random.Random(10)
    rows = [(k, prose(rng.randrange(1, 40), VOCAB, rng)) for k in range(80)] + [(900, "never met words"), (901, "ab"), (902, "")]
    docs = docs_of(spark, rows)
    words = lm.vocabulary(docs)
    weights = lm.train(docs, words)
    e, place, w, b, wc, bc, wi, bi = [x.astype(float) for x in weights]
    token = dict(zip(words["known"].tolist(), zip(words["token"].tolist(), words["within"].tolist())))

    def log_softmax(z):
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    for r in lm.score(docs, words, weights).collect():
        text = dict(rows)[r["doc_id"]].encode()
        hashes, starts, ends, _ = common.word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), common.ALNUM, True)
        ids = [token.get(h, (0, None))[0] for h in hashes.tolist()]
        total = 0.0
        for i, h in enumerate(hashes.tolist()):
            around = [ids[i + d] if 0 <= i + d < len(ids) else len(e) - 1 for d in (-2, -1, 1, 2)]
            hidden = np.tanh(sum(e[a] * p for a, p in zip(around, place)) @ w + b)
            of, at = divmod(ids[i], wc.shape[1])
            total += log_softmax(hidden @ wc + bc)[of] + log_softmax(hidden @ wi + bi[of])[at]
            total += token[h][1] if h in token else lm.spelled(np.frombuffer(text.lower(), np.uint8), starts[i:i + 1], ends[i:i + 1], words["spelling"])[0]
        assert r["n_tokens"] == len(ids) and abs(r["log_likelihood"] - total) < 1e-3 * max(1, abs(total))
