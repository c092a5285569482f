"""PII surrogates: each entity gets one replacement of its own kind, wherever
it occurs in the corpus. The given and the family name of a person are entities
each, also where the text names that person again without a title; names that
no honorific introduces in their text are not found.

Replacements are drawn by a keyed hash of the entity (``entities``). Distinct
entities must stay distinct and no replacement may be an entity of the corpus,
so the table of distinct entities is checked as a whole: of those that drew the
same replacement the first by hash keeps it, the others and those that drew an
original draw again, from surrogates that grow with the attempt, until none
collides (few remain after each round). Texts
without entities pass through in place; only texts with entities meet the
table, by a hash of the text, so copies and rows with equal or null doc_ids
need no key of their own.

Defined cases: null and empty texts pass unchanged; digits that fail the check
of a card number, and numbers of other shapes, are left alone; repeated rows
get equal results; empty tables give empty results; all columns are handed
through, whatever their names, and an ``n_chars`` column follows the new text.
"""

from __future__ import annotations

import hashlib
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from rollout_tables.llm import entities
from rollout_tables.llm.common import arrow_map, refresh_n_chars, scratch, table

KEY = b"surrogates"  # for tests: known to everybody
KEY_SETTING = "spark.rollout_tables.surrogateKey"


def session_key(spark: SparkSession) -> bytes:
    """The secret of the session, under which surrogates are drawn. Without
    one the test key serves, and whoever knows it can look surrogates up."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are drawn under a public key", stacklevel=2)
        return KEY
    return key.encode()


def _free(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that the table does not have."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _mark(text: str) -> str:
    return hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()


def _split(docs: DataFrame, wanted: bool, added: list[str]) -> DataFrame:
    """Rows with entities, with their mark and distinct entities under the two
    names of ``added``, or the rows without."""
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows, marks, lists = [], [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                found = entities.detect(text) if text else []
                if bool(found) == wanted:
                    rows.append(i)
                    if wanted:
                        marks.append(_mark(text))
                        lists.append(sorted({f"{kind}:{identity}" for _, _, kind, identity in found}))
            part = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, pa.string()), pa.array(lists, pa.list_(pa.string()))], [*names, *added]) if wanted else part

    schema = StructType(list(docs.schema.fields))
    return arrow_map(docs, run, schema.add(added[0], StringType()).add(added[1], ArrayType(StringType())) if wanted else schema)


def surrogate_table(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """Distinct entities (``entity``, kind:identity) -> entity, surrogate."""
    def draw(attempt):
        def run(batches):
            for batch in batches:
                kinds = [e.split(":", 1) for e in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{k}:{entities.surrogate(key, k, i, attempt)}" for k, i in kinds], pa.string())], ["entity", "surrogate"])
        return run

    originals = scratch(found.distinct(), "pii-entities")
    settled, open_, attempt = None, originals, 0
    while True:
        drawn = scratch(arrow_map(open_, draw(attempt), "entity string, surrogate string"), "pii-drawn")
        rival = drawn.groupBy("surrogate").agg(F.min(F.struct(F.xxhash64("entity"), "entity"))["entity"].alias("first"))
        taken = originals.select(F.col("entity").alias("surrogate"), F.lit(True).alias("taken"))
        if settled is not None:
            taken = taken.unionByName(settled.select("surrogate", F.lit(True).alias("taken")))
        judged = drawn.join(rival, "surrogate").join(taken.distinct(), "surrogate", "left").withColumn("good", (F.col("entity") == F.col("first")) & F.col("taken").isNull())
        good = judged.filter("good").select("entity", "surrogate")
        settled = scratch(good if settled is None else settled.unionByName(good), "pii-settled")
        open_ = scratch(judged.filter("not good").select("entity"), "pii-open")
        if open_.isEmpty():
            return settled
        attempt += 1


def replace_entities(docs: DataFrame, key: bytes | None = None, counted: bool = False) -> DataFrame:
    """``docs`` with entities replaced in ``text``, under the key of the
    session where none is given; with ``counted`` also n_entities, the number
    of places replaced (in place of a column of that name).

    The surrogates of each distinct text are written before the rows meet
    them, so that a text with many copies is split between tasks."""
    key = session_key(docs.sparkSession) if key is None else key
    docs = docs.drop("n_entities") if counted else docs
    names, at = docs.columns, docs.columns.index("text")
    mark, listed, new, count = (_free(n, names) for n in ("__mark", "__found", "__new", "__count"))
    holding = scratch(_split(docs, True, [mark, listed]), "pii-texts")
    mapping = surrogate_table(holding.select(F.explode(listed).alias("entity")), key)
    pairs = scratch(holding.select(mark, F.explode(listed).alias("entity")).distinct().join(mapping, "entity")
                    .groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(new)), "pii-pairs")

    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for text, new in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                new, parts, end = dict(new), [], 0
                found = entities.detect(text)
                for start, stop, kind, identity in found:
                    parts += [text[end:start], entities.spell(kind, new[f"{kind}:{identity}"].split(":", 1)[1], text[start:stop])]
                    end = stop
                texts.append("".join([*parts, text[end:]]))
                counts.append(entities.mentions(found, text))
            arrays = [*batch.columns[:len(names)]]
            arrays[at] = pa.array(texts, arrays[at].type)
            arrays = refresh_n_chars(names, arrays, at)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], [*names, count])

    schema = StructType(list(docs.schema.fields)).add(count, "long")
    changed = arrow_map(holding.drop(listed).join(pairs, mark).drop(mark), run, schema)
    every = _split(docs, False, []).withColumn(count, F.lit(0).cast("long")).unionByName(changed)
    return every.withColumnRenamed(count, "n_entities") if counted else every.drop(count)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return replace_entities(docs, counted=True)
