"""Toxicity by multiple-instance learning.

A document is a bag of sentences; a sentence's score is a logistic function of
the words in it and of their beginnings (prefixes of 4, 5 and 6 bytes, for
inflected and compound words), and the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are known, so the weights are trained
through the noisy-or, on a bounded sample of labelled documents
(``labelled.TRAIN_ROWS``). Words enter the model if their document counts in
the sample, taken by Spark, differ between the labels (likelihood ratio). The
sample's sentences, cut down to those words, and the weights are bounded by the
sample; every document is then scored in place, without a shuffle, and the
sentences that score 0.5 or more are located.

Defined cases: null and empty texts hold one empty sentence; without labelled
rows, or with one label only, there are no words and the score only counts
sentences; rows that repeat a doc_id are scored one by one; a null doc_id is
not held out and never used for training; empty tables give empty results.
Scores use no column but the text; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm.common import ALNUM, LOWER, arrow_map, chunks, crc_of_id, doc_of, range_hashes, scratch, signed, split_words, table, utf8
from rollout_tables.llm.labelled import TRAIN_ROWS, training_texts

FOLDS, HELD = 5, 0
LEAST_DOCS = 3
LEAST_RATIO = 10.83  # likelihood ratio at p = 0.001
PREFIXES = (4, 5, 6)
STOP = np.zeros(256, np.int64)
STOP[list(b".!?\n\r")] = 1


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Byte starts and ends of the words, their document, their sentence number
    (over the chunk), and the sentences per document. Sentences hold a word at
    least; a text without words is one empty sentence."""
    lowered = LOWER[data]
    starts, ends, first = split_words(lowered, offsets, ALNUM)
    n = len(offsets) - 1
    doc = doc_of(first)
    if not len(starts):
        return lowered, starts, ends, doc, doc, np.ones(n, np.int64)
    mark = np.cumsum(STOP[data])[starts]
    new = np.r_[True, (mark[1:] != mark[:-1]) | (doc[1:] != doc[:-1])]
    return lowered, starts, ends, doc, np.cumsum(new) - 1, np.maximum(np.bincount(doc[new], minlength=n), 1)


def features(lowered, starts, ends):
    """(hash, word number) of every word and of every prefix shorter than its word."""
    hashes, at = [range_hashes(lowered, starts, ends)], [np.arange(len(starts))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        hashes.append(range_hashes(lowered, starts[long], starts[long] + k) + np.uint64(k))
        at.append(long)
    return np.concatenate(hashes), np.concatenate(at)


def _softplus(z):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _pairs(vocabulary, words, number):
    """Distinct (sentence, vocabulary word), both as numbers."""
    if not len(vocabulary) or not len(words):
        return np.zeros((0, 2), np.int64)
    at = np.searchsorted(vocabulary, words)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == words
    return np.unique(np.c_[number[known], at[known]], axis=0)


def train(y, plain, sentence_doc, pair_sentence, pair_word, n_words, steps: int = 300, rate: float = 0.1, l2: float = 1e-4):
    """Weights and bias by full-batch Adam on the noisy-or likelihood.
    plain: sentences of each document without a vocabulary word; the others
    are numbered, with their document."""
    n = len(y)
    theta = np.zeros(n_words + 1)
    share = (y.sum() + 1) / (n + 2)
    theta[-1] = np.log(np.expm1(-np.log1p(-share) / max(1.0, (plain.sum() + len(sentence_doc)) / max(n, 1))))
    if n < 2 or not len(pair_word):
        return theta[:-1], float(theta[-1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(pair_sentence, w[pair_word], len(sentence_doc))
        total = plain * _softplus(b) + np.bincount(sentence_doc, _softplus(z), n)
        slope = (1 - y) - y / np.expm1(np.maximum(total, 1e-6))
        g = slope[sentence_doc] / (1 + np.exp(-z)) / n
        grad = np.r_[np.bincount(pair_word, g[pair_sentence], n_words) + l2 * w, g.sum() + (slope * plain).sum() / (1 + np.exp(-b)) / n]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """(vocabulary hashes, weights, bias)."""
    def per_text(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(0))
                lowered, starts, ends, doc, _, _ = sentences(data, offsets)
                found, at = features(lowered, starts, ends)
                pairs = np.unique(np.rec.fromarrays([doc[at], found], names="d,w")) if len(at) else np.rec.fromarrays([doc, found], names="d,w")
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(pairs.d)), signed(np.ascontiguousarray(pairs.w))], ["y", "word"])

    sample = scratch(training_texts(docs, labels, "toxic", FOLDS, HELD, train_rows).select("text", "y"), "toxicity-sample")
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).head()
    seen = arrow_map(sample, per_text, "y int, word long").groupBy("word").agg(F.count("*").alias("df"), F.sum("y").alias("pos")).filter(F.col("df") >= LEAST_DOCS)
    counts = seen.toArrow()  # bounded by the sample's words
    df, pos, hashes = (counts.column(c).to_numpy().astype(float) if c != "word" else counts.column(c).to_numpy().view(np.uint64) for c in ("df", "pos", "word"))
    share = totals.pos / max(totals.n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(pos > 0, pos * np.log(pos / (df * share)), 0) + np.where(df > pos, (df - pos) * np.log((df - pos) / (df * (1 - share))), 0)) if 0 < share < 1 else np.zeros(len(df))
    vocabulary = np.sort(hashes[ratio > LEAST_RATIO])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def narrow(batches):
        vocabulary = shared.value
        for batch in batches:
            for part in chunks(batch):
                lowered, starts, ends, doc, number, per = sentences(*utf8(part.column(0)))
                found, at = features(lowered, starts, ends)
                pairs = _pairs(vocabulary, found, number[at])
                owner = doc[np.searchsorted(number, pairs[:, 0])] if len(pairs) else np.zeros(0, np.int64)
                cut = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(per), *(pa.ListArray.from_arrays(cut, pa.array(pairs[:, k])) for k in (0, 1))], ["y", "n", "sentence", "word"])

    rows = sorted(((r.y, r.n, [s - r.sentence[0] for s in r.sentence], r.word) for r in arrow_map(sample, narrow, "y int, n long, sentence array<long>, word array<long>").toLocalIterator()))
    y, plain, sentence_doc, pair_sentence, pair_word = [], [], [], [], []
    for k, (label, n, numbers, at) in enumerate(rows):
        own, local = np.unique(np.array(numbers, np.int64), return_inverse=True)
        pair_sentence.extend((local + len(sentence_doc)).tolist())
        pair_word.extend(at)
        sentence_doc.extend([k] * len(own))
        y.append(label), plain.append(n - len(own))
    as_int = lambda x: np.array(x, np.int64)
    weights, bias = train(np.array(y, float), np.array(plain, float), as_int(sentence_doc), as_int(pair_sentence), as_int(pair_word), len(vocabulary))
    return vocabulary, weights, bias


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score, offending (byte start, byte end, score of each sentence
    scored 0.5 or more; bytes of the UTF-8 text, first to last word)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        vocabulary, weights, bias = shared.value
        plain_score = _softplus(bias)
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(1))
                lowered, starts, ends, doc, number, per = sentences(data, offsets)
                found, of = features(lowered, starts, ends)
                pairs = _pairs(vocabulary, found, number[of])
                own, local = np.unique(pairs[:, 0], return_inverse=True)
                z = bias + np.bincount(local, weights[pairs[:, 1]], len(own)) if len(own) else np.zeros(0)
                at = doc[np.searchsorted(number, own)] if len(own) else np.zeros(0, np.int64)
                with_words = np.bincount(at, minlength=len(per))
                total = (per - with_words) * plain_score + np.bincount(at, _softplus(z), len(per))
                bad = np.flatnonzero(z >= 0)
                lists: list[list] = [[] for _ in per]
                for k in bad.tolist():
                    a, b = np.searchsorted(number, [own[k], own[k] + 1])
                    base = offsets[at[k]]
                    lists[at[k]].append({"first": int(starts[a] - base), "end": int(ends[b - 1] - base), "score": float(1 / (1 + np.exp(-z[k])))})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(-np.expm1(-total)), pa.array(lists, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))], ["doc_id", "score", "offending"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, run, "doc_id long, score double, offending array<struct<first:long,end:long,score:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_of_id() % FOLDS == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
