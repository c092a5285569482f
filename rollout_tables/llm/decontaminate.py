"""Benchmark decontamination by an FM-index for each shard of documents.

A benchmark item gives its windows of 10 consecutive words (all its words if it
has fewer). Documents are worked on in shards of bounded text size; a shard's
words become ids of the benchmark's vocabulary, and words outside it are ends
that no occurrence can cross. Stretches too short to hold any window are left
out, the rest is indexed; every window is searched backward through wavelet
ranks, occurrences are located by sampled suffix positions, and their word
ranges are merged into removal spans.

The benchmark is read in blocks of bounded size (``BLOCK_WORDS``); each block
is broadcast and is one more narrow pass that adds to the spans found so far,
so documents are never shuffled, and the size of a block changes no result.

Defined cases: null and empty texts have no words and are never contaminated;
an item without words has no window; items that repeat an item_id count once;
an item whose item_id is null hits words but is not counted or listed; every
document row, repeated or with a null doc_id, is judged by itself; empty
tables give empty (no documents) or clean (no benchmark) results. Columns of
the documents are handed through by ``remove_spans``, whatever their names.
"""

from __future__ import annotations

from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rollout_tables.llm.common import (
    ALNUM, LOWER, arrow_map, chunks, doc_of, joined_words, refresh_n_chars, same_bytes, scratch, table, utf8, word_hashes,
)
from rollout_tables.llm.fmindex import FMIndex

WINDOW = 10
BLOCK_WORDS = 1_000_000


def _block(items: list, window: int) -> dict:
    """Windows of some (item_id, text) as ids of their own vocabulary."""
    names = sorted({str(i) for i, _ in items if i is not None})
    number = {name: k for k, name in enumerate(names)}
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    data, salt = LOWER[data], 0
    hashes, starts, ends, first = word_hashes(data, offsets, ALNUM, lower=False)
    raw = data.tobytes()
    words = {raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())}
    while len(np.unique(hashes)) < len(words):  # two words with one hash: another salt
        salt += 1
        hashes = word_hashes(data, offsets, ALNUM, lower=False, salt=salt)[0]
    vocabulary, named, ids = np.unique(hashes, return_index=True, return_inverse=True)
    spelled, spelled_at = joined_words(data, starts[named], ends[named])
    owners: dict[tuple, set] = {}
    for (item, _), a, b in zip(items, first[:-1], first[1:]):
        for s in range(a, max(a + (b > a), b - window + 1)):
            owners.setdefault(tuple((ids[s:min(s + window, b)] + 1).tolist()), set()).add(number.get(str(item)) if item is not None else -1)
    patterns = np.zeros((len(owners), window), np.int64)
    lengths = np.array([len(w) for w in owners], np.int64)
    for k, w in enumerate(owners):
        patterns[k, :len(w)] = w
    listed = [sorted(o for o in owner if o >= 0) for owner in owners.values()]
    return {"names": names, "vocabulary": vocabulary, "salt": salt, "spelled": spelled, "spelled_at": spelled_at, "patterns": patterns, "lengths": lengths,
            "owner_at": np.r_[0, np.cumsum([len(o) for o in listed], dtype=np.int64)], "owner": np.array([o for own in listed for o in own], np.int64)}


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int | None = None):
    """Blocks of windows, each of bounded size, read one after another."""
    block_words = block_words or BLOCK_WORDS
    held, words = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if row.text:
            held.append((row.item_id, row.text))
            words += row.text.count(" ") + row.text.count("\n") + 1
        if words >= block_words:
            yield _block(held, window)
            held, words = [], 0
    if held:
        yield _block(held, window)


def occurrences(data, offsets, block: dict):
    """Occurrences in a shard: (word start, word end, window number) arrays, the
    words' byte starts and ends, and first words of the documents."""
    data = LOWER[data]
    hashes, starts, ends, first = word_hashes(data, offsets, ALNUM, lower=False, salt=block["salt"])
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, starts, ends, first)
    vocabulary, lengths = block["vocabulary"], block["lengths"]
    if not len(hashes) or not len(lengths):
        return nothing
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == hashes
    # stretches of known words, cut at documents, long enough for the shortest window
    doc = doc_of(first)
    begin = np.flatnonzero(known & np.r_[True, ~known[:-1] | (doc[1:] != doc[:-1])])
    end = np.flatnonzero(known & np.r_[~known[1:] | (doc[1:] != doc[:-1]), True]) + 1
    long = end - begin >= lengths.min()
    begin, size = begin[long], (end - begin)[long]
    if not len(begin):
        return nothing
    slot = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum() + len(size)), np.int64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    word = np.repeat(begin, size) + inside
    place = np.repeat(slot, size) + inside
    # a word counts as known by its bytes, not by its hash
    spelled, spelled_at = block["spelled"], block["spelled_at"]
    sizes = (ends - starts)[word]
    equal = np.diff(spelled_at)[at[word]] - 1 == sizes
    equal[equal] = same_bytes(data, starts[word[equal]], spelled, spelled_at[at[word[equal]]], sizes[equal])
    text[place] = np.where(equal, at[word] + 1, 0)
    word_at = np.full(len(text), -1, np.int64)
    word_at[place] = word
    index = FMIndex(text, len(vocabulary))
    lo, hi = index.find(block["patterns"], lengths)
    hit = np.flatnonzero(lo < hi)
    n = (hi - lo)[hit]
    window = np.repeat(hit, n)
    rows = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = word_at[index.locate(rows)]
    return s, s + lengths[window], window, starts, ends, first


def _merged(s: np.ndarray, e: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in any of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, s, 1)
    np.add.at(steps, e, -1)
    return np.cumsum(steps[:-1]) > 0


def _widened(spans: list, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list:
    """Each document's merged spans, with some occurrences added."""
    doc = np.searchsorted(first[1:], s, side="right")
    spans = [x or [] for x in spans]
    for d in np.unique(doc).tolist():
        own = doc == d
        a, n = int(first[d]), int(first[d + 1] - first[d])
        before = np.array(spans[d], np.int64).reshape(-1, 2)
        inside = _merged(np.r_[s[own] - a, before[:, 0]], np.r_[e[own] - a, before[:, 1]], n)
        edge = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
        spans[d] = edge.reshape(-1, 2).tolist()
    return spans


def _items_of(block, window, doc) -> list[tuple[int, int]]:
    """Distinct (document, item number) of some occurrences."""
    pairs = np.unique(np.c_[doc, window], axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    n = np.diff(block["owner_at"])[pairs[:, 1]]
    which = np.repeat(block["owner_at"][pairs[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.unique(np.c_[np.repeat(pairs[:, 0], n), block["owner"][which]], axis=0).tolist()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (first and end word of each merged removal span),
    items (ids of the items with occurring windows) for every row."""
    def search(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            block = shared.value
            names = block["names"]
            for batch in batches:
                for part in chunks(batch):
                    s, e, window_at, starts, _, first = occurrences(*utf8(part.column(1)), block)
                    doc = np.searchsorted(first[1:], s, side="right")
                    items = [set(x) for x in part.column(4).to_pylist()]
                    for d, item in _items_of(block, window_at, doc):
                        items[d].add(names[item])
                    spans = _widened(part.column(3).to_pylist(), s, e, first)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "text", "n_words", "spans", "items"])

        return run

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<array<bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for k, block in enumerate(chain(benchmark_blocks(benchmark, window), [None])):
        if block is None and k:
            break
        found = arrow_map(found, search(block or _block([], window)), "doc_id long, text string, n_words long, spans array<array<bigint>>, items array<string>")
    return found.drop("text")


def _cut(data: np.ndarray, spans: list, starts: np.ndarray, ends: np.ndarray) -> str:
    """A text without some spans of its words, and what stands inside them."""
    raw, kept, at = data.tobytes(), [], 0
    for a, b in spans:
        kept.append(raw[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def _without(text: str, block: dict) -> str:
    """Text without any window: spans go until none is left (cutting can bring
    words together)."""
    while True:
        data, offsets = utf8(pa.array([text], pa.string()))
        s, e, _, starts, ends, first = occurrences(data, offsets, block)
        if not len(s):
            return text
        text = _cut(data, _widened([[]], s, e, first)[0], starts, ends)


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with benchmark passages cut out of ``text``; all rows and
    columns stay, and an ``n_chars`` column follows the new length. A benchmark
    of one block is one narrow pass. Of more blocks, the spans of all are found
    in the same text and cut at once, and the rows that changed are searched
    for all blocks again until none is found, which gives the same texts."""
    fields = docs.columns
    at = fields.index("text")

    def cut(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            block = shared.value
            for batch in batches:
                for part in chunks(batch, "text"):
                    s, *_, first = occurrences(*utf8(part.column(at)), block)
                    if len(s):
                        texts = part.column(at).to_pylist()
                        for d in np.unique(np.searchsorted(first[1:], s, side="right")).tolist():
                            texts[d] = _without(texts[d], block)
                        arrays = [*part.columns]
                        arrays[at] = pa.array(texts, part.column(at).type)
                        part = pa.RecordBatch.from_arrays(refresh_n_chars(fields, arrays, at), schema=part.schema)
                    yield part

        return run

    def search(block):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches):
            for batch in batches:
                for part in chunks(batch, "text"):
                    s, e, *_, first = occurrences(*utf8(part.column(at)), shared.value)
                    spans = _widened(part.column(len(fields)).to_pylist(), s, e, first)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(spans, pa.list_(pa.list_(pa.int64())))], part.schema.names)

        return run

    def cut_found(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                spans = part.column(len(fields)).to_pylist()
                arrays = [*part.columns[:-1]]
                if any(spans):
                    texts = arrays[at].to_pylist()
                    for d in (d for d, own in enumerate(spans) if own):
                        data, offsets = utf8(pa.array([texts[d]], pa.string()))
                        _, starts, ends, _ = word_hashes(data, offsets, ALNUM, lower=True)
                        texts[d] = _cut(data, spans[d], starts, ends)
                    arrays[at] = pa.array(texts, arrays[at].type)
                    arrays = refresh_n_chars(fields, arrays, at)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([bool(x) for x in spans], pa.bool_())], [*fields, "__cut"])

    few = list(islice(benchmark_blocks(benchmark, window), 2))
    if len(few) < 2:
        return arrow_map(docs, cut(few[0]), docs.schema) if few else docs
    clean, schema = None, docs.schema
    while True:
        found = docs.withColumn("__spans", F.expr("cast(array() as array<array<bigint>>)"))
        for block in benchmark_blocks(benchmark, window):
            found = arrow_map(found, search(block), found.schema)
        done = arrow_map(found, cut_found, StructType([*schema.fields, StructField("__cut", BooleanType())]))
        done = scratch(done, "decontaminate-cut")
        kept = done.filter(~F.col("__cut")).drop("__cut")
        clean = kept if clean is None else clean.unionByName(kept)
        docs = done.filter("__cut").drop("__cut")
        if docs.isEmpty():
            return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
