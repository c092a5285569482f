"""op3: whole names, accounts and addresses, the key, columns and hot texts."""

import re

import pytest
from pyspark.sql import functions as F

from rollout_tables.llm import entities, pii

NAMED = [
    ("Mr John Paul Smith", ["John", "Paul", "Smith"]), ("Mrs Anna Smith-Jones", ["Anna", "Smith", "Jones"]), ("Mr. O'Brien", ["O'Brien"]),
    ("Dr. J. Smith", ["J", "Smith"]), ("Prof J.R. Tolkien", ["J", "R", "Tolkien"]), ("Ms Anna M. Kim", ["Anna", "M", "Kim"]), ("MR JOHN SMITH", ["JOHN", "SMITH"]),
    ("Monsieur de Gaulle", ["Gaulle"]), ("Herr Ludwig van der Rohe", ["Ludwig", "Rohe"]), ("Señora María de la Cruz", ["María", "Cruz"]),
    ("Sir Jean-Luc D’Angelo", ["Jean", "Luc", "D’Angelo"]), ("Госпожа Анна Ивановна Петрова-Водкина", ["Анна", "Ивановна", "Петрова", "Водкина"]), ("ГОСПОДИН ИВАНОВ", ["ИВАНОВ"]),
]


@pytest.mark.parametrize("written,parts", NAMED)
def test_every_part_of_a_name_is_found(written, parts):
    for text in (f"Then {written} came", f"{written}.", f"({written}'s), {written}"):
        found = entities.detect(text)
        n = text.count(written)
        assert [text[a:b] for a, b, k, _ in found] == parts * n and entities.mentions(found, text) == n


@pytest.mark.parametrize("text", ["MS WORD and MS Office", "I miss the sea", "Mr. who", "MR big", "std::a ab::cd 12:34:56 ::1", "DE00 3704 0044 0532 0130 00", "AB12 CDEF", "a1:b2"])
def test_what_is_no_name_or_number_stays(text):
    assert entities.detect(text) == []


@pytest.mark.parametrize("written,kind", [("DE89 3704 0044 0532 0130 00", "iban"), ("GB29NWBK60161331926819", "iban"), ("2001:db8::ff00:42:8329", "ipv6"), ("FE80::1", "ipv6"),
                                          ("Ünal@exämple.de", "email"), ("почта@пример.рф", "email"), ("a.b@xn--e1afmkfd.xn--p1ai", "email")])
def test_accounts_and_addresses(written, kind):
    for text in (f"to {written} BANK now", written, f"({written}), more"):
        (start, stop, found, identity), = entities.detect(text)
        assert (text[start:stop], found) == (written, kind)
        new = [entities.spell(kind, entities.surrogate(b"k", kind, identity, n), written) for n in range(40)]
        assert len(set(new)) == 40 and all([k for *_, k, _ in entities.detect(x)] == [kind] for x in new)
        if kind == "iban":
            assert all(len(x) == len(written) and x[:2] == written[:2] and [c == " " for c in x] == [c == " " for c in written] for x in new)


def test_planted_names_leave_no_part(spark):
    """An independent list of what must go, looked for as plain words."""
    secret = {i: parts for i, (_, parts) in enumerate(NAMED)}
    rows = [(i, f"yesterday {written} met us; {parts[-1]} left, {parts[0]}'s bag stayed" if len(parts[0]) > 1 else f"yesterday {written} met us") for i, (written, parts) in enumerate(NAMED)]
    got = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, parts in secret.items():
        for part in parts:
            assert len(part) == 1 or not re.search(rf"(?<!\w){part}(?!\w)", got[i]), (got[i], part)
        assert got[i].startswith("yesterday ") and got[i].split(" ")[1] == rows[i][1].split(" ")[1]
    assert re.search(r"MR [A-Z]+ [A-Z]+ met us", got[6]) and " de la " in got[9]
    family = got[0].split(" met")[0].split(" ")[-1]  # Smith, as in the double name, the initials and in capitals
    assert f" {family}-" in got[1] and got[3].split(" met")[0].endswith(family) and family.upper() in got[6]


def test_key_of_the_session(spark):
    docs = spark.createDataFrame([(1, "a.b@example.com of Mr Smith")], "doc_id long, text string")
    with pytest.warns(UserWarning, match="public key"):
        public = pii.replace_entities(docs).first().text
    spark.conf.set(pii.KEY_SETTING, "another secret")
    try:
        own = pii.replace_entities(docs).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert own == pii.replace_entities(docs, b"another secret").first().text != public == pii.replace_entities(docs, pii.KEY).first().text


def test_columns_of_the_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "x@y.com", 7, "a", "b", "c", 5), (2, None, 8, "d", None, "f", 6)],
                                 "doc_id long, text string, n_entities int, __mark string, __FOUND string, __new string, __count int")
    got = pii.replace_entities(docs, counted=True)
    assert got.columns == ["doc_id", "text", "__mark", "__FOUND", "__new", "__count", "n_entities"]
    assert {r.doc_id: (r.n_entities, r["__mark"], r["__FOUND"], r["__count"]) for r in got.collect()} == {1: (1, "a", "b", 5), 2: (0, "d", None, 6)}
    assert pii.replace_entities(docs).columns == docs.columns


def test_a_text_with_many_copies_is_split(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        text = F.when(F.col("id") % 3 == 0, F.lit("write to hot@example.com")).otherwise(F.concat(F.lit("write to u"), F.col("id"), F.lit("@example.com")))
        docs = spark.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"), F.sha2(F.col("id").cast("string"), 512).alias("more"))
        out = pii.replace_entities(docs)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 6000 and len({r.text for r in rows}) == 4001
    assert plan.count("SortMergeJoin") == 1 and "SortMergeJoin(skew=true)" in plan
