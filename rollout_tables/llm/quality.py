"""Quality classifier: histogram gradient-boosted trees on text statistics.

Every text becomes a row of statistics (lengths, character classes, repeated
words, lines and word pairs, shape of words and lines), computed for whole
chunks of documents at once. The trees are fitted in numpy on a bounded sample
of labelled documents (``labelled.TRAIN_ROWS`` ids) and broadcast as flat
arrays (bounded by trees x nodes); every document is then scored in place,
without a shuffle.

Defined cases: null and empty texts have all-zero statistics and are scored
like any other; without labelled rows, or with one label only, every score is
the smoothed share of label 1; rows that repeat a doc_id are scored one by
one; a null doc_id is not held out and never used for training; empty tables
give empty results. Scores use no column but the text. ``keep_good`` hands all
columns of the kept rows through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm import gbt
from rollout_tables.llm.common import LOWER, NON_SPACE, arrow_map, chunks, crc_of_id, doc_of, range_hashes, split_words, table, utf8
from rollout_tables.llm.labelled import TRAIN_ROWS, training_texts

FOLDS, HELD = 3, 1

# character classes of single bytes
CLASSES = ["space", "newline", "lower", "upper", "digit", "sentence", "comma", "quote", "bracket", "other", "high", "tail"]
CLASS = np.full(256, CLASSES.index("other"), np.uint8)
for _name, _bytes in (("space", b" \t"), ("newline", b"\n\r"), ("lower", bytes(range(0x61, 0x7B))), ("upper", bytes(range(0x41, 0x5B))), ("digit", b"0123456789"), ("sentence", b".!?"), ("comma", b",;:-"), ("quote", b"\"'`"), ("bracket", b"()[]{}<>|/\\"), ("high", bytes(range(0xC0, 0x100))), ("tail", bytes(range(0x80, 0xC0)))):
    CLASS[list(_bytes)] = CLASSES.index(_name)


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int):
    """Per document: number of distinct keys, and count of the most frequent."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    size = np.diff(np.r_[head, len(d)])
    most = np.zeros(n)
    np.maximum.at(most, d[head], size)
    return np.bincount(d[head], minlength=n).astype(float), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text of a chunk."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    count = np.zeros((n, len(CLASSES)))
    owner = np.repeat(np.arange(n), size)
    if len(data):
        count = np.bincount(owner * len(CLASSES) + CLASS[data], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    chars = np.maximum(size - count[:, -1], 1)
    starts, ends, first = split_words(data, offsets, NON_SPACE)
    doc, words = doc_of(first), np.diff(first)
    width = (ends - starts).astype(float)
    many = np.maximum(words, 1)
    lowered = LOWER[data]
    keys = range_hashes(lowered, starts, ends) if len(data) else np.zeros(0, np.uint64)
    distinct, most = _distinct(doc, keys, n)
    same = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1]) if len(keys) else np.zeros(0, bool)
    repeats = np.bincount(doc[1:][same], minlength=n) if len(doc) else np.zeros(n)
    pairs, _ = _distinct(doc[1:], keys[1:] * np.uint64(31) + keys[:-1], n) if len(doc) > 1 else (np.zeros(n), None)
    is_line = np.ones(256, bool)
    is_line[[0x0A, 0x0D]] = False
    l_starts, l_ends, l_first = split_words(data, offsets, is_line)
    l_doc, lines = doc_of(l_first), np.maximum(np.diff(l_first), 1)
    l_distinct, _ = _distinct(l_doc, range_hashes(lowered, l_starts, l_ends) if len(data) else l_doc.astype(np.uint64), n)
    mean = np.bincount(doc, width, n) / many
    spread = np.sqrt(np.maximum(np.bincount(doc, width ** 2, n) / many - mean ** 2, 0))
    letter_end = np.isin(CLASS[data[ends - 1]], [2, 3, 10, 11]) if len(ends) else np.zeros(0, bool)
    odd_end = np.isin(CLASS[data[ends - 1]], [CLASSES.index("other"), CLASSES.index("bracket")]) if len(ends) else np.zeros(0, bool)
    upper_start = CLASS[data[starts]] == CLASSES.index("upper") if len(starts) else np.zeros(0, bool)
    single = width == 1
    by_word = [np.bincount(doc, v, n) / many for v in (letter_end, odd_end, upper_start, single)]
    total = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, spread, count / chars[:, None], *by_word,
        distinct / many, most / many, repeats / many, pairs / many, distinct / np.sqrt(many),
        np.log1p(lines), words / lines, l_distinct / lines, count[:, 3] / np.maximum(count[:, 2] + count[:, 3], 1), total / many,
    ])


def features_of(docs: DataFrame) -> DataFrame:
    """(y, x) of labelled documents."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                x = statistics(*utf8(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    return arrow_map(docs.select("text", "y"), run, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> gbt.Trees:
    """Trees fitted on a bounded sample outside the held-out fold."""
    rows = features_of(training_texts(docs, labels, "quality", FOLDS, HELD, train_rows)).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), float) if len(y) else np.zeros((0, 1))
    order = np.lexsort((*x.T[::-1], y)) if len(y) else np.zeros(0, np.int64)  # the same fit for any order of rows
    return gbt.fit(x[order], y[order])


def _scored(docs: DataFrame, trees: gbt.Trees, keep: bool):
    shared = docs.sparkSession.sparkContext.broadcast((trees.feature, trees.threshold, trees.value, trees.base))
    at = docs.columns.index("text")

    def run(batches):
        trees = gbt.Trees(*shared.value)
        for batch in batches:
            for part in chunks(batch):
                score = trees.probability(statistics(*utf8(part.column(at))))
                yield part.filter(pa.array(score >= 0.5)) if keep else pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """doc_id, score for every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, _scored(docs, trees, False), "doc_id long, score double")


def keep_good(docs: DataFrame, trees: gbt.Trees) -> DataFrame:
    """The rows scored 0.5 or more, with all their columns."""
    return arrow_map(docs, _scored(docs, trees, True), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(crc_of_id() % FOLDS == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
