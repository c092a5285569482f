"""Source divergence audit: how far the words of each source of a language lie
from those of its other sources and of the whole language.

Words are counted exactly, by their bytes, inside the Arrow batches first; one
row a (language, source, term) and batch is shuffled, so a hot source arrives
as sums. A language keeps the terms that enough of its documents hold. With
smoothed shares p (group) and q, in billionths, a term's divergence is
(p - q)^2 / (p + q), rounded down.

Part ``term``, the terms that mark a group out, uses a dominance skyband. With
p > q the divergence grows with the group's count and falls with the
language's, and ties go to the earlier term; so a term that k others dominate
(count in the group as high, in the language as low, earlier UTF-8) cannot be
among the first k. Each partition keeps its terms that fewer than k others of
the group dominate, comparing only with those already kept (any k dominators
include k kept ones); the skybands are merged by group and ranked exactly.

Part ``pair`` sums the divergence over all kept terms for each two sources of a
language. With f00 the value of a term that neither holds, the sum is V * f00,
plus each side's excess where the other holds none (from the histogram of its
shares, joined to the sources), plus a correction for each term both hold
(from the join on the term, one order of two sources, summed in the task).

Defined cases: null text, language and source are empty. A group without kept
terms has all its ``pair`` rows and no ``term`` rows; a language with one
source has no ``pair`` rows; without kept terms every value is 0. Repeated
rows count as often as they occur. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollout_tables.llm.common import LOWER, arrow_map, chunks, doc_of, scratch, split_words, table, utf8

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LETTER[0x80:] = True

COUNTS = "lang string, source string, term string, cnt long, docs long"
GROUP = ["lang", "source"]


def _terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one array: their bytes lie one after another once all
    other bytes are gone."""
    inside = LETTER[data]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]]))])


def _counted(part: pa.RecordBatch) -> pa.RecordBatch | None:
    """(lang, source, term, occurrences, documents) of one chunk of texts."""
    data, offsets = utf8(part.column("text"))
    starts, ends, first = split_words(data, offsets, LETTER)
    if not len(starts):
        return None
    words = _terms(data, starts, ends).dictionary_encode()
    langs, sources = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
    codes = np.asarray(langs.indices, np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
    # any row of a group names it
    _, row_of, group_of_doc = np.unique(codes, return_index=True, return_inverse=True)
    n_words = len(words.dictionary)
    in_doc, times = np.unique(doc_of(first) * n_words + np.asarray(words.indices, np.int64), return_counts=True)
    cells, at = np.unique(group_of_doc[in_doc // n_words] * n_words + in_doc % n_words, return_inverse=True)
    docs = np.bincount(at, minlength=len(cells))
    count = np.zeros(len(cells), np.int64)
    np.add.at(count, at, times)
    row = pa.array(row_of[cells // n_words])
    term = words.dictionary.take(pa.array(cells % n_words)).view(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays([part.column("lang").take(row), part.column("source").take(row), term, pa.array(count), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "cnt", "docs"])


def count_terms(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of every (lang, source, term)."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                if (out := _counted(part)) is not None:
                    yield out

    return arrow_map(docs.select("lang", "source", "text"), run, COUNTS).groupBy(*GROUP, "term").agg(
        F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))


def _share(count, total, kept):
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact at any size."""
    return F.when(kept > 0, F.lit(1) + F.call_function(
        "div", F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"), (total + 2 * kept).cast("decimal(20,0)")))


F_OF = "CAST(({p} - {q}) * ({p} - {q}) AS BIGINT) DIV ({p} + {q})"


def _f(p: str, q: str):
    return F.expr(F_OF.format(p=p, q=q))


def kept_cells(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of the terms that at least ``min_docs`` documents of the
    language hold, with the count in the whole language; ``first`` marks one
    row a (lang, term). A window holds one term's sources."""
    w = Window.partitionBy("lang", "term")
    out = counts.withColumns({"lang_docs": F.sum("docs").over(w), "lang_cnt": F.sum("cnt").over(w),
                              "first": F.col("source") == F.min("source").over(w)})
    return out.filter(F.col("lang_docs") >= min_docs).select(*GROUP, "term", "cnt", "lang_cnt", "first")


def group_sizes(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Every occurring group with its count of kept terms, that of its
    language, the language's kept terms (``v``), and the shares of a term it
    does not hold (``p0``)."""
    sums = cells.groupBy(*GROUP).agg(F.sum("cnt").alias("n"), F.count_if("first").alias("firsts"))
    found = docs.select(*GROUP).distinct().join(sums, GROUP, "left").fillna(0, ["n", "firsts"])
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("firsts").alias("v"))
    out = found.drop("firsts").join(langs, "lang")
    return out.withColumn("p0", _share(F.lit(0), F.col("n"), F.col("v")))


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """The rows of each partition that fewer than ``k`` others of their group
    there dominate. One pass in order of falling group count; a task holds the
    kept rows of one group, earlier terms first, never the partition."""
    names = rows.columns

    def run(batches):
        group, terms, langs, size = None, [], np.zeros(64, np.int64), 0
        for batch in batches:
            keep = []
            columns = [batch.column(names.index(c)).to_pylist() for c in (*GROUP, "term", "lang_cnt")]
            for i, (lang, source, term, lang_cnt) in enumerate(zip(*columns)):
                if (lang, source) != group:
                    group, terms, size = (lang, source), [], 0
                # the order of UTF-8 bytes is that of code points
                at = bisect_left(terms, term)
                if np.count_nonzero(langs[:at] <= lang_cnt) >= k:
                    continue
                keep.append(i)
                if size == len(langs):
                    langs = np.concatenate([langs, np.zeros_like(langs)])
                langs[at + 1:size + 1] = langs[at:size].copy()
                langs[at] = lang_cnt
                terms.insert(at, term)
                size += 1
            if keep:
                yield batch.take(pa.array(keep))

    ordered = rows.sortWithinPartitions(*GROUP, F.desc("cnt"), "lang_cnt", "term")
    return arrow_map(ordered, run, rows.schema)


def marking_terms(cells: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Part ``term``: the first ``top`` terms of each group by divergence from
    the language, of those more frequent in the group."""
    x = cells.join(groups, GROUP).withColumns({
        "p": _share(F.col("cnt"), F.col("n"), F.col("v")), "q": _share(F.col("lang_cnt"), F.col("lang_n"), F.col("v"))})
    x = x.filter(F.col("p") > F.col("q")).select(*GROUP, "term", "cnt", "lang_cnt", _f("p", "q").alias("value"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term")
    ranked = skyband(x, top).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    return ranked.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def source_pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: the divergence of each two sources of a language, over
    all its kept terms, ranked for each source."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    x = cells.join(groups.select(*GROUP, "n", "v", "p0"), GROUP).select(
        *GROUP, "term", "p0", _share(F.col("cnt"), F.col("n"), F.col("v")).alias("p"))
    pairs = groups.join(other, "lang").filter(F.col("source") != F.col("other"))
    base = pairs.select(*GROUP, "other", F.when(F.col("v") > 0, F.col("v") * _f("p0", "q0")).otherwise(F.lit(0)).alias("value"))
    shares = x.groupBy(*GROUP, "p0", "p").agg(F.count(F.lit(1)).alias("terms"))
    excess = shares.join(other, "lang").filter(F.col("source") != F.col("other")).select(
        *GROUP, "other", (F.col("terms") * (_f("p", "q0") - _f("p0", "q0"))).alias("value"))
    y = x.select("lang", F.col("source").alias("other"), "term", F.col("p0").alias("q0"), F.col("p").alias("q"))
    both = x.join(y, ["lang", "term"]).filter(F.col("source") < F.col("other")).groupBy(*GROUP, "other").agg(
        F.sum(_f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0")).alias("value"))

    def mirrored(df):
        return df.select("lang", F.explode(F.array(F.struct("source", "other"), F.struct(
            F.col("other").alias("source"), F.col("source").alias("other")))).alias("o"), "value").select("lang", "o.*", "value")

    one_side = base.unionByName(mirrored(excess)).unionByName(mirrored(both))
    value = one_side.groupBy(*GROUP, "other").agg(F.sum("value").alias("value"))
    w = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "other")
    return value.select(*GROUP, F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(w).alias("rank"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    cells = scratch(kept_cells(count_terms(docs), min_docs), "divergence-cells")
    groups = scratch(group_sizes(docs, cells), "divergence-groups")
    return source_pairs(cells, groups).unionByName(marking_terms(cells, groups, top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))
