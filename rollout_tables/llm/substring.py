"""Substring dedup: word windows that also start in an earlier document go.

Seed: every 20-word sequence is hashed, and of each 31 neighbouring ones the
smallest is kept (winnowing), so every window of 50 words owns one anchor, and
equal windows own equal anchors at the same place. Documents are joined on
anchors that occur in two documents or more.

Extend: an anchor's neighbourhood reaches both ways over all windows that own
it (up to 80 words). Where the whole neighbourhood (a SHA-256 digest of its
words, not a hash that different words can share) also occurs in a document of
smaller id, all its windows repeat. Otherwise its windows are compared one by
one, each distinct neighbourhood giving its windows once. Nothing is compared
pair by pair, so a passage in thousands of documents costs one row each.
Repeated windows that touch are merged into maximal repeats, which are removed.

Defined cases: null and empty texts have no words; fewer than 50 words are
never removed; a null doc_id is never smaller or larger than another, so such
rows lose nothing and remove nothing; rows that repeat a doc_id never remove
one another's words, each row is judged by itself; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm.common import (
    NON_SPACE, arrow_map, chunks, joined_words, range_hashes, scratch, signed, split_words, table, utf8, word_hashes,
)

WINDOW = 50
SEED_WORDS = 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width] for every full window."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[:len(x) - (width - span)], x[width - span:])


def digests(data, starts, ends, first_words, end_words, more=None) -> list[bytes]:
    """128 bits of SHA-256 of each run of words (their bytes, one space behind
    each): equal only for equal words."""
    joined, begin = joined_words(data, starts, ends)
    raw = memoryview(joined)
    slices = zip(begin[first_words].tolist(), begin[end_words].tolist(), more or itertools.repeat(b""))
    return [hashlib.sha256(b"".join((extra, raw[a:b]))).digest()[:16] for a, b, extra in slices]


def neighbourhoods(data, offsets, window: int, seed: int):
    """Anchors of a chunk with the run of windows that own them: document,
    first window (word index in the document), number of windows, anchor hash,
    neighbourhood hash; and the word hashes and first words."""
    words, starts, ends, first = word_hashes(data, offsets, NON_SPACE, lower=False)
    n = len(words)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64), [], words, starts, ends, first
    at = np.arange(n - seed + 1)
    grams = range_hashes(words, at, at + seed)
    bits = np.uint64(max(1, int(n).bit_length()))
    keyed = (grams >> bits << bits) | at.astype(np.uint64)  # ties: the leftmost
    owner = (_sliding_min(keyed, window - seed + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.arange(n - window + 1)
    whole = begin + window <= first[1:][doc[:n - window + 1]]
    begin, owner = begin[whole], owner[whole]
    if not len(begin):
        return empty, empty, empty, empty.astype(np.uint64), [], words, starts, ends, first
    run = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (begin[1:] != begin[:-1] + 1)])
    count = np.diff(np.r_[run, len(begin)])
    left = begin[run]
    shape = ((owner[run] - left) * 1024 + count).tolist()
    around = digests(data, starts, ends, left, left + count + window - 1, [s.to_bytes(8, "big") for s in shape])
    return doc[left], left - first[doc[left]], count, grams[owner[run]], around, words, starts, ends, first


def _kept(data: bytes, starts, ends, drop=None) -> tuple[str, int]:
    """Digest of the kept words joined by a space, and the number dropped."""
    if drop is None:
        pieces = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        return hashlib.sha256(b" ".join(pieces)).hexdigest(), 0
    pieces = [data[s:e] for s, e, d in zip(starts.tolist(), ends.tolist(), drop.tolist()) if not d]
    return hashlib.sha256(b" ".join(pieces)).hexdigest(), int(drop.sum())


def _covered(n: int, spans) -> np.ndarray:
    """Which of n words lie in the maximal repeats made of (first word, end) spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, [s for s, _ in spans], 1)
    np.add.at(steps, [e for _, e in spans], -1)
    return np.cumsum(steps[:-1]) > 0


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """(matched, texts): the repeated windows as (doc_id, mark, first, end) word
    spans, and the text of every document that shares an anchor, each once per
    (doc_id, mark); mark is a hash of the row's text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")

    def seeds(batches):
        for batch in batches:
            for part in chunks(batch):
                doc, left, count, gram, around, *_ = neighbourhoods(*utf8(part.column(2)), window, seed)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), signed(gram), pa.array(around, pa.binary()), pa.array(left.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc_id", "mark", "anchor", "around", "left", "count"])

    anchors = scratch(arrow_map(rows, seeds, "doc_id long, mark long, anchor long, around binary, left int, count int"), "substring-anchors")
    # both sides of the joins on a hot anchor are tables, so that their large partitions can be split
    shared = scratch(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select(F.col("anchor").alias("shared")), "substring-shared")
    met = scratch(anchors.join(shared, F.col("anchor") == F.col("shared")).drop("shared"), "substring-met")
    least = scratch(met.groupBy("anchor", "around").agg(F.min("doc_id").alias("least")), "substring-least")
    judged = scratch(met.join(least, ["anchor", "around"]), "substring-judged")
    full = judged.filter("doc_id > least").select("doc_id", "mark", F.col("left").alias("first"), (F.col("left") + F.col("count") + F.lit(window - 1)).alias("end"))
    # anchors with several neighbourhoods: the first document of each gives its windows
    several = scratch(least.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(F.col("anchor").alias("several")), "substring-several")
    open_ = judged.filter("doc_id = least").join(several, F.col("anchor") == F.col("several"))
    # rows that repeat a document ask once
    asked = open_.select("doc_id", "mark", "anchor", "left", "count").distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("anchor", "left", "count")).alias("asked"))
    wanted = met.select("doc_id", "mark").distinct().join(asked, ["doc_id", "mark"], "left").select(F.col("doc_id").alias("w_id"), F.col("mark").alias("w_mark"), "asked")
    texts = scratch(rows.join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).drop("w_id", "w_mark").dropDuplicates(["doc_id", "mark"]), "substring-texts")

    def windows(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(2))
                starts, ends, first = split_words(data, offsets, NON_SPACE)
                lists = part.column(3)
                flat = lists.flatten()
                lengths = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(part.num_rows), lengths)
                anchor, left, count = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                which = np.repeat(np.arange(len(anchor)), count)
                step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                begin = left[which] + step
                at = first[doc[which]] + begin
                owner = pa.array(doc[which])
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(anchor[which]), pa.array(digests(data, starts, ends, at, at + window), pa.binary()), pa.array(begin.astype(np.int32))], ["doc_id", "mark", "anchor", "window", "first"])

    single = scratch(arrow_map(texts.filter("asked is not null").select("doc_id", "mark", "text", "asked"), windows, "doc_id long, mark long, anchor long, window binary, first int"), "substring-windows")
    earliest = single.groupBy("anchor", "window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("anchor", "window", "least")
    partial = single.join(earliest, ["anchor", "window"]).filter("doc_id > least").select("doc_id", "mark", "first", (F.col("first") + F.lit(window)).alias("end"))
    return full.unionByName(partial), texts.drop("asked")


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))

    def whole(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(2))
                starts, ends, first = split_words(data, offsets, NON_SPACE)
                raw = data.tobytes()
                digests = [_kept(raw, starts[a:b], ends[a:b])[0] for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(digests)], ["doc_id", "mark", "n_words", "sha"])

    def cut(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(2))
                starts, ends, first = split_words(data, offsets, NON_SPACE)
                raw = data.tobytes()
                found = [_kept(raw, starts[a:b], ends[a:b], _covered(b - a, [(s["first"], s["end"]) for s in spans])) for a, b, spans in zip(first[:-1], first[1:], part.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([d for d, _ in found], pa.string())], ["c_id", "c_mark", "removed", "cut_sha"])

    matched, texts = repeats(docs, window, seed)
    spans = matched.distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("first", "end")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("mark").alias("s_mark"), "spans")
    fewer = arrow_map(texts.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("mark") == F.col("s_mark"))).select("doc_id", "mark", "text", "spans"), cut, "c_id long, c_mark long, removed long, cut_sha string")
    every = arrow_map(rows, whole, "doc_id long, mark long, n_words long, sha string")
    return every.join(fewer, (F.col("doc_id") == F.col("c_id")) & (F.col("mark") == F.col("c_mark")), "left").select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
