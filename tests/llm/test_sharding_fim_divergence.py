"""Sharding, fill-in-middle and source divergence against brute force, and
their defined cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from rollout_tables.llm import divergence, fim, sharding
from rollout_tables.llm.oracle import SQL

SF001 = "/root/testdata/sf0.001"
BLANKS = " \t\n\v\f\r"


def duck(sql, table="documents"):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF001}/{table}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(r[i] for i in sorted(range(len(names)), key=names.__getitem__)) for r in got.fetchall()), key=repr)


def spark_rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


# --- 11 sharding -------------------------------------------------------------

def pmf(population, marked, draws):
    whole = math.comb(population, draws)
    return {k: math.comb(marked, k) * math.comb(population - marked, draws - k) / whole
            for k in range(max(0, draws + marked - population), min(marked, draws) + 1)}


@pytest.mark.parametrize("population,marked,draws", [(10, 4, 5), (10, 9, 8), (7, 7, 3), (7, 3, 7), (12, 1, 11), (500, 21, 250), (5000, 300, 700), (90000, 40000, 6000)])
def test_one_draw_has_the_hypergeometric_law(spark, population, marked, draws):
    m = 20000  # an even grid of uniform numbers gives each value its own share
    sql = sharding.hypergeometric(f"{population}L", f"{marked}L", f"{draws}L", f"((id + 0.5D) / {m})")
    got = {r["k"]: r["n"] for r in spark.range(m).select(F.expr(sql).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    want = pmf(population, marked, draws)
    assert set(got) <= set(want)
    assert all(abs(got.get(k, 0) / m - p) < 3 / m for k, p in want.items())


def test_a_large_draw_keeps_to_mean_and_deviation(spark):
    population, marked, draws = 10 ** 11, 4 * 10 ** 9, 10 ** 7
    sql = sharding.hypergeometric(f"{population}L", f"{marked}L", f"{draws}L", "((id + 0.5D) / 200)")
    r = spark.range(200).select(F.expr(sql).alias("k")).agg(F.avg("k"), F.stddev("k")).first()
    share = marked / population
    assert abs(r[0] - draws * share) < 1 and abs(r[1] / math.sqrt(draws * share * (1 - share)) - 1) < 0.02


def test_dealing_to_several_children_against_all_shuffles(spark):
    places, children = [2, 1, 1], [1, 2, 1]
    n = 6000
    frame = spark.range(n).select(F.array(*[F.lit(p).cast("long") for p in places]).alias("places"), F.array(*[F.struct(
        (F.col("id") * 3 + i).alias("id"), F.lit(c).cast("long").alias("n")) for i, c in enumerate(children)]).alias("children"))
    dealt = frame.select(F.expr(sharding._deal(7, 1)).alias("d")).select(F.to_json(F.col("d.places")).alias("m"))
    got = {r["m"]: r["count"] / n for r in dealt.groupBy("m").count().collect()}
    want = Counter()
    bins = [s for s, p in enumerate(places) for _ in range(p)]
    rows = [c for c, k in enumerate(children) for _ in range(k)]
    for order in itertools.permutations(bins):
        table = [[0] * len(places) for _ in children]
        for row, shard in zip(rows, order):
            table[row][shard] += 1
        want[str(table).replace(" ", "")] += 1 / math.factorial(len(bins))
    assert set(got) == set(want)
    assert all(abs(got[k] - p) < 5 * math.sqrt(p / n) for k, p in want.items())


def check_law(rows, shards):
    by = defaultdict(list)
    for shard, slot in rows:
        by[shard].append(slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))


@pytest.mark.parametrize("parts,fanout,bucket_rows", [(1, 64, 65536), (11, 2, 3), (40, 3, 50)])
def test_sizes_slots_and_rows(spark, parts, fanout, bucket_rows):
    df = spark.range(1003).repartition(parts).withColumn("copy", F.col("id") % 3)
    out = sharding.shard_rows(df, 7, seed=3, fanout=fanout, bucket_rows=bucket_rows).collect()
    check_law([(r["shard"], r["slot"]) for r in out], 7)
    assert sorted(r["id"] for r in out) == list(range(1003))


def test_shuffle_is_even_over_shards_and_slots(spark):
    n, shards = 24000, 12
    out = sharding.shard_rows(spark.range(n).repartition(6), shards).withColumn("old", F.floor(F.col("id") / (n // 12))).collect()
    cells = Counter((r["old"], r["shard"]) for r in out)
    expected = n / 144
    chi = sum((cells[c] - expected) ** 2 / expected for c in itertools.product(range(12), range(shards)))
    assert 121 - 5 * math.sqrt(242) < chi < 121 + 5 * math.sqrt(242)
    halves = Counter((r["old"], r["slot"] * 2 // (n // shards)) for r in out)
    assert all(abs(halves[o, h] - 1000) < 5 * math.sqrt(500) for o in range(12) for h in range(2))


def test_sharding_defined_cases(spark):
    rows = [(None, None, "a", 9)] * 40 + [(1, "", "b", 8)] * 3 + [(2, "é" * 70000, None, None)] + [(i, "text", "c", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, key int").withColumn("part", F.lit("p")).withColumn("a.b", F.lit(1))
    out = sharding.shard_rows(df, 24)
    assert out.columns == ["doc_id", "text", "key", "part", "a.b", "shard", "slot"]
    got = out.collect()
    check_law([(r["shard"], r["slot"]) for r in got], 24)
    assert Counter((r["doc_id"], r["text"], r["key"]) for r in got) == Counter((a, b, d) for a, b, _, d in rows)
    empty = sharding.shard_rows(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_sharding_query(spark, tmp_dir):
    out = sharding.query(spark, SF001)
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = out.collect()
    check_law([(r["shard"], r["slot"]) for r in got], 24)
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    for r in got:
        raw = (want[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    spark.createDataFrame([(1, None)], "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    assert [(r["size"], r["text_crc32"]) for r in sharding.query(spark, tmp_dir).collect()] == [(8, 0)]


def test_sharding_runs_no_python(spark):
    df = sharding.query(spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- 12 fill in the middle ---------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    h = [int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_text(rng):
    alphabet = BLANKS + "ab<>PSM\x00\x1c\x85é日  𝄞"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))


def test_fim_against_plain_loop(spark):
    rng = random.Random(12)
    rows = [(i, odd_text(rng)) for i in range(600)] + [(None, None), (None, "a b c"), (-5, None), (700, ""), (701, " \n"), (702, "x <P> y"), (2, "same text"), (2, "same text")]
    rows += [(i, "<" + "S a <S b > c P> <M") for i in range(703, 720)]
    rows += [(i, " ".join(rng.choice(["wörd", "日本\n", "x"]) for _ in range(400000))) for i in (4, 7)]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((i, *plain_fim(i, t), t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_fim_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "x", 5, "y", [1])], "doc_id long, text string, form string, n int, `odd. name` string, row array<int>")
    out = fim.fill_in_middle(df)
    assert out.columns == ["doc_id", "odd. name", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    r = out.first()
    assert (r["odd. name"], r["row"], r["n"]) == ("y", [1], 2)
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_fim_parameters(spark):
    df = spark.createDataFrame([(i, "one two three four") for i in range(60)], "doc_id long, text string")
    assert {r["form"] for r in fim.fill_in_middle(df, fim_percent=100, spm_percent=0).collect()} == {"psm"}
    assert {r["form"] for r in fim.fill_in_middle(df, fim_percent=0).collect()} == {"plain"}
    a, b = (Counter(r["prefix_chars"] for r in fim.fill_in_middle(df, seed=s, fim_percent=100).collect()) for s in (1, 2))
    assert a != b


def test_fim_query_against_sql(spark):
    assert spark_rows(fim.query(spark, SF001)) == duck(SQL["op12_fill_in_middle"])


# --- 13 source divergence ----------------------------------------------------

def plain_audit(rows, min_docs, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, in_lang, docs, groups = Counter(), Counter(), Counter(), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = word.findall((text or "").translate(lower))
        groups.add((lang, source))
        for t in terms:
            count[lang, source, t] += 1
            in_lang[lang, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        v = len(kept)
        total = {s: sum(count[lang, s, t] for t in kept) for x, s in groups if x == lang}
        whole = sum(in_lang[lang, t] for t in kept)

        def share(c, n):
            return 1 + 10 ** 9 * (c + 2) // (n + 2 * v)

        def ranked(part, values, limit=None):
            order = sorted(values, key=lambda x: (-x[1], x[0].encode()))
            out.extend((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order[:limit]))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        ranked("pair", [(o, sum(f(share(count[lang, source, t], total[source]), share(count[lang, o, t], total[o])) for t in kept))
                        for o in total if o != source])
        marks = []
        for t in kept:
            p, q = share(count[lang, source, t], total[source]), share(in_lang[lang, t], whole)
            if count[lang, source, t] and p > q:
                marks.append((t, f(p, q)))
        ranked("term", marks, top)
    return sorted(out, key=repr)


def some_documents(rng, n=220):
    vocab = ["Alpha", "beta", "GAMMA", "déjà", "ÉCOLE", "日本", "x", "zz", "don", "t"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(n):
        source = rng.choice(["s0", "s0", "s0", "s1", "s10", "ß", None])
        lang = rng.choice(["en", "en", "de", "", None])
        words = [rng.choice(vocab[rng.randrange(len(vocab)):] or vocab) for _ in range(rng.randrange(12))]
        rows.append((lang, source, rng.choice([" ", "1", "'", "\n"]).join(words)))
    rows += [("fr", "only", "one two"), ("xx", "a", None), ("xx", "b", ""), ("xx", "c", "123 _"), (None, None, None)]
    rows += [("en", "s0", "Alpha beta Alpha")] * 30 + [("en", "far", "beta " * 50000)]
    return rows


@pytest.mark.parametrize("parts,min_docs,top", [(1, 10, 10), (7, 10, 3), (5, 1, 2)])
def test_divergence_against_plain_loop(spark, parts, min_docs, top):
    rows = some_documents(random.Random(parts))
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x")).repartition(parts)
    got = divergence.audit(df, min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_audit(rows, min_docs, top)


def test_skyband_keeps_what_fewer_than_k_dominate(spark):
    rng = random.Random(4)
    rows = [("l", f"s{i % 2}", f"t{i:03}", rng.randrange(1, 9), rng.randrange(9, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, cnt long, lang_cnt long").coalesce(1)
    for k in (1, 4):
        want = [r for r in rows if sum(o[1] == r[1] and o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in rows) < k]
        assert sorted(tuple(r) for r in divergence.skyband(df, k).collect()) == sorted(want)


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9 * 10 ** 12
    got = spark.range(1).select(divergence._share(F.lit(big), F.lit(big + 7), F.lit(5))).first()[0]
    assert got == 1 + 10 ** 9 * (big + 2) // (big + 7 + 10)


def test_divergence_empty_table_and_sql(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.audit(empty).count() == 0
    assert spark_rows(divergence.query(spark, SF001)) == duck(SQL["op13_source_divergence"])
