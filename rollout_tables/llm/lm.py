"""Masked pseudo-likelihood: a bidirectional window network scores documents.

The vocabulary follows the corpus: Spark counts all lower-cased words, and every
word met ``LEAST`` times or more is in it. The ``NAMED`` most frequent have a
token of their own; the others share tokens, dealt by hash into buckets of about
``BUCKET_WORDS`` words (so their number grows with the corpus), and a word has a
probability within its bucket: its count less a discount, and the discounts of
the bucket dealt out by spelling. Words met less often, or never, are one token
times the probability of their spelling: an interpolated byte trigram model,
counted over the corpus's words below ``LEAST``. So each word has a probability
of its own. Over all byte strings they sum to 1 less what the spelling model
gives to words of the vocabulary.

For every place the network sees ``SIDE`` tokens on each side and none of the
token itself: their embeddings, each weighted by its place, are added and pass a
tanh layer. The output is a distribution over the tokens in two steps (class,
then token within the class), so it is normalised and cheap. A document's score
is the sum over all its words of log p(word | both sides).

Training predicts every place of every document once: round ``turn`` masks the
places whose number in the document is ``turn`` modulo the number of rounds.
Texts are split once, into arrays of token ids, which all rounds and the
scoring read. Documents are dealt to trainers by a digest of id and text, a
trainer for ``TRAINER_TOKENS`` tokens, so the result does not depend on the
files. In each round every trainer runs its own Adagrad over its documents; the
weights, weighted by tokens, are averaged by a tree reduction, so what is
gathered grows with the corpus and what reaches the driver does not. Scoring
then covers every place of every document.

Defined cases: null and empty texts have no tokens and score 0; rows with equal
or null doc_ids are scored one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm.common import ALNUM, LOWER, arrow_map, chunks, scratch, signed, table, utf8, word_hashes

CLASSES = 64  # at least; the classes are as many as the tokens of a class
VOCABULARY = CLASSES * CLASSES
NAMED = VOCABULARY - 1
BUCKET_WORDS = 256
LEAST = 8
DISCOUNT = 0.5
SIDE = 2
WIDTH = 16
ROUNDS = 2
RATE = 0.15
STEP = 512
SCORED = 2048
TRAINER_TOKENS = 2_500_000
END, START, SYMBOLS = 256, 257, 258  # of the spelling model; the others are bytes
BACKOFF = 4.0  # weight of the lower order in the spelling model
HELD = 1 << 20


def _trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Codes of the trigrams of words and their ends, and each word's first."""
    size = ends - starts + 1
    first = np.cumsum(size) - size
    inside = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(starts, size) + inside
    sign = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int64) if len(data) else np.zeros(len(at), np.int64)
    sign[first + size - 1] = END
    one, two = np.roll(sign, 1), np.roll(sign, 2)
    one[inside < 1] = START
    two[inside < 2] = START
    return (two * SYMBOLS + one) * SYMBOLS + sign, first


def spelling(codes: np.ndarray, n: np.ndarray) -> dict:
    """Byte trigram model, interpolated with lower orders, from counts by code."""
    order = np.argsort(codes)
    codes, n = codes[order], n[order].astype(float)
    pair, sign = np.divmod(codes, SYMBOLS)
    after = np.bincount(pair, n, SYMBOLS * SYMBOLS)
    two = np.bincount(pair % SYMBOLS * SYMBOLS + sign, n, SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
    one = np.bincount(sign, n, SYMBOLS) + 1
    one[START] = 0
    two = (two + BACKOFF * one / one.sum()) / (two.sum(axis=1, keepdims=True) + BACKOFF)
    share = BACKOFF / (after + BACKOFF)
    seen = n / (after[pair] + BACKOFF) + share[pair] * two.ravel()[codes % (SYMBOLS * SYMBOLS)]
    two[:, START] = 1  # never asked
    return {"codes": codes, "seen": np.log(seen), "share": np.log(share), "two": np.log(two).ravel()}


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: dict) -> np.ndarray:
    """Log-probability of each word's spelling (lower-case bytes) and its end."""
    if not len(starts):
        return np.zeros(0)
    codes, first = _trigrams(data, starts, ends)
    logs = model["share"][codes // SYMBOLS] + model["two"][codes % (SYMBOLS * SYMBOLS)]
    if len(model["codes"]):
        at = np.searchsorted(model["codes"], codes)
        at[at == len(model["codes"])] = 0
        logs = np.where(model["codes"][at] == codes, model["seen"][at], logs)
    return np.add.reduceat(logs, first)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts], dtype=np.int64)]


def vocabulary(docs: DataFrame) -> dict:
    """Words met LEAST times or more (``known``, sorted hashes) with their token
    and log-probability within it, the number of classes, and the spelling model."""
    def count(batches):
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(0))
                found, starts, ends, _ = word_hashes(data, offsets, ALNUM, lower=True)
                words, at, n = np.unique(found, return_index=True, return_counts=True)
                raw = LOWER[data].tobytes()
                spelt = [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays([signed(words), pa.array(spelt, pa.binary()), pa.array(n)], ["word", "spelt", "n"])

    def rare(batches):
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, held_n, size = [], [], 0

        def merged():
            every, at = np.unique(np.concatenate([codes, *held]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([n, *held_n]), len(every)).astype(np.int64)

        for batch in batches:
            data, offsets = _bytes_of(batch.column(0))
            own, first = _trigrams(data, offsets[:-1], offsets[1:])
            held.append(own)
            held_n.append(np.repeat(batch.column(1).to_numpy(), np.diff(np.r_[first, len(own)])))
            size += len(own)
            if size >= HELD:
                codes, n = merged()
                held, held_n, size = [], [], 0
        codes, n = merged()
        for k in range(0, len(codes), HELD):
            yield pa.RecordBatch.from_arrays([pa.array(codes[k:k + HELD]), pa.array(n[k:k + HELD])], ["code", "n"])

    def rate(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column(1))
            logs = spelled(data, offsets[:-1], offsets[1:], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(logs / np.diff(offsets))], ["word", "n", "spelling"])

    counts = arrow_map(docs.select(F.col("text").cast("string").alias("text")), count, "word long, spelt binary, n long")
    counts = scratch(counts.groupBy("word", "spelt").agg(F.sum("n").alias("n")), "lm-words")
    trigrams = arrow_map(counts.filter(F.col("n") < LEAST).select("spelt", "n"), rare, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    model = spelling(trigrams.column("code").to_numpy(), trigrams.column("n").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = arrow_map(counts.filter(F.col("n") >= LEAST), rate, "word long, n long, spelling double").toArrow()
    words, n, spelt = (kept.column(c).to_numpy() for c in ("word", "n", "spelling"))
    words = words.view(np.uint64)
    order = np.lexsort((words, -n))
    words, n, spelt = words[order], n[order].astype(float), np.exp(spelt[order])
    token, within = np.arange(1, len(words) + 1), np.zeros(len(words))
    buckets = -(-max(len(words) - NAMED, 0) // BUCKET_WORDS)
    if buckets:
        bucket, n, spelt = (words[NAMED:] % np.uint64(buckets)).astype(np.int64), n[NAMED:], spelt[NAMED:]
        token[NAMED:] = 1 + NAMED + bucket
        held = DISCOUNT * np.bincount(bucket)[bucket] * spelt / np.bincount(bucket, spelt)[bucket]
        within[NAMED:] = np.log((n - DISCOUNT + held) / np.bincount(bucket, n)[bucket])
    order = np.argsort(words)
    classes = max(CLASSES, int(np.ceil(np.sqrt(1 + NAMED + buckets))))
    return {"known": words[order], "token": token[order], "within": within[order], "classes": classes, "spelling": model}


def start_weights(classes: int = CLASSES) -> list[np.ndarray]:
    rng = np.random.default_rng(7)
    f = np.float32
    return [(rng.normal(0, 0.1, (classes * classes + 1, WIDTH))).astype(f),  # embeddings; the last is beyond the ends
            np.ones((2 * SIDE, WIDTH), f) + rng.normal(0, 0.1, (2 * SIDE, WIDTH)).astype(f),  # places
            rng.normal(0, 0.3, (WIDTH, WIDTH)).astype(f), np.zeros(WIDTH, f),
            np.zeros((WIDTH, classes), f), np.zeros(classes, f),
            np.zeros((WIDTH, classes), f), np.zeros((classes, classes), f)]


def token_ids(found: np.ndarray, words: dict) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (0 for words outside the vocabulary) and log-probabilities within
    them. Classes of tokens hold words of similar frequency."""
    known = words["known"]
    if not len(known):
        return np.zeros(len(found), np.int64), np.zeros(len(found))
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    same = known[at] == found
    return np.where(same, words["token"][at], 0), np.where(same, words["within"][at], 0.0)


def contexts(ids: np.ndarray, first: np.ndarray, places: np.ndarray, beyond: int = VOCABULARY) -> np.ndarray:
    """Token ids around places (columns -SIDE .. -1, 1 .. SIDE), cut at documents."""
    if len(places) * 4 > len(ids):
        sizes = np.diff(first)
        begin, end = np.repeat(first[:-1], sizes)[places], np.repeat(first[1:], sizes)[places]
    else:
        doc = np.searchsorted(first[1:], places, side="right")
        begin, end = first[doc], first[doc + 1]
    out = np.empty((len(places), 2 * SIDE), ids.dtype)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        at = places + shift
        inside = at >= begin if shift < 0 else at < end
        out[:, k] = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], beyond)
    return out


def _softmax(z, at, safe):
    """Exponentials of each row (in place), their sum, and the logarithm of
    the probability of one of them. ``safe``: no entry can overflow."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    rows = np.arange(len(z))
    own = z[rows, at]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    return z, total, own - np.log(total)


def forward(weights, around, target):
    """Log-probabilities of the targets, and what the gradient needs."""
    e, place, w, b, wc, bc, wi, bi = weights
    seen = [e[around[:, k]] for k in range(2 * SIDE)]
    total = sum(x * p for x, p in zip(seen, place))
    hidden = np.tanh(total @ w + b)
    of, within = np.divmod(target, wc.shape[1])
    # the hidden units are within -1 and 1
    safe_class = np.abs(wc).sum(0).max() + np.abs(bc).max() < 60
    safe_word = np.abs(wi).sum(0).max() + np.abs(bi).max() < 60
    by_class, n_class, log_class = _softmax(hidden @ wc + bc, of, safe_class)
    z = hidden @ wi
    z += bi[of]
    by_word, n_word, log_word = _softmax(z, within, safe_word)
    return log_class + log_word, (seen, total, hidden, of, within, by_class, n_class, by_word, n_word)


def _row_sums(at, values):
    """Distinct rows, and the sum of the values of each."""
    order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")
    sorted_at = at[order]
    head = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    return sorted_at[head], np.add.reduceat(values[order], head, axis=0)


def gradient(weights, around, target):
    """Gradient of the mean negative log-probability: (rows or all, values)."""
    e, place, w, b, wc, bc, wi, bi = weights
    _, (seen, total, hidden, of, within, dc, n_class, di, n_word) = forward(weights, around, target)
    n, rows = len(target), np.arange(len(target))
    dc *= (1 / (n * n_class))[:, None]
    di *= (1 / (n * n_word))[:, None]
    dc[rows, of] -= 1 / n
    di[rows, within] -= 1 / n
    dh = (dc @ wc.T + di @ wi.T) * (1 - hidden ** 2)
    dt = dh @ w.T
    every, ones = slice(None), np.ones(n, dc.dtype)
    de = np.concatenate([dt * p for p in place])
    return [_row_sums(around.T.ravel(), de), (every, np.stack([np.einsum("nd,nd->d", x, dt) for x in seen])),
            (every, total.T @ dh), (every, ones @ dh), (every, hidden.T @ dc), (every, ones @ dc), (every, hidden.T @ di), _row_sums(of, di)]


def places_of(first: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Places that a round predicts: over all rounds, each place once."""
    return np.flatnonzero((np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))) % rounds == turn)


def tokenised(docs: DataFrame, words: dict) -> DataFrame:
    """(doc_id, mark, ids, fixed) of every row: its token ids, and the part of
    its score that no context changes (words within their tokens, spellings).
    ``mark`` deals documents to trainers: a digest of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text"))

    def run(batches):
        words = shared.value
        for batch in batches:
            for part in chunks(batch):
                data, offsets = utf8(part.column(1))
                found, starts, ends, first = word_hashes(data, offsets, ALNUM, lower=True)
                ids, logs = token_ids(found, words)
                rare = np.flatnonzero(ids == 0)
                logs[rare] = spelled(LOWER[data], starts[rare], ends[rare], words["spelling"])
                sums = np.r_[0.0, np.cumsum(logs)]
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists, pa.array(sums[first[1:]] - sums[first[:-1]])], ["doc_id", "mark", "ids", "fixed"])

    return arrow_map(rows, run, "doc_id long, mark long, ids array<int>, fixed double")


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a batch, and the first of each document (n + 1)."""
    lists = batch.column(batch.schema.get_field_index("ids"))
    first = np.asarray(lists.offsets)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), (first - first[0]).astype(np.int64)


def train(docs: DataFrame, words: dict, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The network's weights, trained on ``docs``."""
    return train_tokens(scratch(tokenised(docs, words), "lm-tokens"), words["classes"], rounds)


def train_tokens(tokens: DataFrame, classes: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights averaged over the trainers, round by round. Documents are dealt
    to trainers, and put in order there, by their mark, and the number of
    trainers follows the number of tokens, so neither the files nor the cores
    change the result."""
    spark = tokens.sparkSession
    weights = start_weights(classes)
    shapes = [w.shape for w in weights]
    total = tokens.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    trainers = max(1, -(-total // TRAINER_TOKENS))
    dealt = tokens.filter(F.size("ids") > 0).select("mark", "ids").repartition(trainers, "mark").sortWithinPartitions("mark")
    for turn in range(rounds if total else 0):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, turn=turn, shared=shared):
            weights = [w.copy() for w in shared.value]
            squares = [np.full_like(w, 1e-2) for w in weights]
            beyond, seen = len(weights[0]) - 1, 0
            for batch in batches:
                ids, first = _ids(batch)
                places = places_of(first, turn, rounds)
                around, targets = contexts(ids, first, places, beyond), ids[places]
                seen += len(ids)
                for k in range(0, len(places), STEP):
                    for w, s, (at, g) in zip(weights, squares, gradient(weights, around[k:k + STEP], targets[k:k + STEP])):
                        own = s[at] + g * g
                        s[at] = own
                        np.sqrt(own, out=own)
                        g /= own
                        g *= RATE
                        w[at] -= g
            if seen:
                flat = np.concatenate([w.ravel() for w in weights]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([(flat * seen).tobytes()], pa.binary())], ["tokens", "weights"])

        parts = arrow_map(dealt, run, "tokens long, weights binary").rdd.map(lambda r: (r.tokens, np.frombuffer(bytes(r.weights))))
        n, flat = parts.treeAggregate((0, 0.0), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=2)
        flat, weights, at = flat / n, [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            weights.append(flat[at:at + size].reshape(shape).astype(np.float32))
            at += size
    return weights


def score(docs: DataFrame, words: dict, weights: list[np.ndarray]) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over all tokens)."""
    return score_tokens(tokenised(docs, words), weights)


def score_tokens(tokens: DataFrame, weights: list[np.ndarray]) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        weights = shared.value
        beyond = len(weights[0]) - 1
        for batch in batches:
            ids, first = _ids(batch)
            logs, around = np.zeros(len(ids)), contexts(ids, first, np.arange(len(ids)), beyond)
            for k in range(0, len(ids), SCORED):
                logs[k:k + SCORED] = forward(weights, around[k:k + SCORED], ids[k:k + SCORED])[0]
            sums = np.r_[0.0, np.cumsum(logs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]] + batch.column(2).to_numpy(zero_copy_only=False))], ["doc_id", "n_tokens", "log_likelihood"])

    return arrow_map(tokens.select("doc_id", "ids", "fixed"), run, "doc_id long, n_tokens long, log_likelihood double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = vocabulary(docs)
    tokens = scratch(tokenised(docs, words), "lm-tokens")
    scored = score_tokens(tokens, train_tokens(tokens, words["classes"]))
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
