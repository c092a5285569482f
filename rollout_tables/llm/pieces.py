"""SentencePiece encoding and decoding by weighted finite-state transducers.

Three machines are compiled from a model file: the normaliser N (dummy prefix,
white space to U+2581, extra white space removed if the model says so), the
piece machine P (each piece's characters in, its id out; a character that is no
piece falls back to its UTF-8 byte pieces) and, for BPE models, the junction
machine J over piece pairs, whose arcs weigh 0 where merging the two pieces'
characters gives back the same two pieces and infinity elsewhere. An input is
composed with them arc by arc from left to right, and the ids are those of the
shortest path in the tropical semiring: for unigram models under the negated
piece scores, for BPE models under J, where the path of finite weight is the
one that greedy merging takes (each prefix has just one, so one state is kept
for each place). Pieces never run from a word into the space after it, so texts
are composed word by word and each worker keeps a bounded table of words.

Defined cases: null and empty texts have no ids and decode to the empty text;
U+2581 in a text decodes to a space, as in the model's own library; every row
is encoded by itself, repeated or not; empty tables give empty results; all
columns are handed through by ``encode``, and its own replace any of the same
names.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from rollout_tables.llm.common import arrow_map, chunks, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
KEEP_WORDS = 500_000
KEEP_CHARS = 64


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            size = varint()
            value, at = raw[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at:at + size], at + size
        yield tag >> 3, value


class Machine:
    """The compiled transducers of one model."""

    def __init__(self, raw: bytes):
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.out: list[bytes] = []
        byte_ids = {}
        trainer, normalizer, self.unknown = {}, {}, 0
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                text, kind = piece[1].decode(), piece.get(3, NORMAL)
                k = len(self.out)
                if kind in (NORMAL, USER, UNUSED):
                    self.ids[text] = k
                    self.score[text] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                    self.out.append(text.replace(SPACE, " ").encode())
                elif kind == BYTE:
                    byte_ids[int(text[3:5], 16)] = k
                    self.out.append(bytes([int(text[3:5], 16)]))
                else:
                    self.unknown = k if kind == UNKNOWN else self.unknown
                    self.out.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2):
            raise ValueError("models with a precompiled character map are not supported")
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.trim = bool(normalizer.get(4, 1))
        self.bytes = [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else None
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        # P for BPE as a trie in one table: characters -> piece number, or -1 within a piece
        self.trie = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | {p: n for n, p in enumerate(self.ids, 1)}
        self.names = ["", *self.ids]
        self.emitted = [b"", *(np.int32(k).tobytes() for k in self.ids.values())]
        self.words = self._segments()
        self.joins: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _segments(self) -> re.Pattern:
        """Where texts may be cut: between characters that no piece holds side
        by side. Before a space, around lone control characters, and between
        letters or digits and a mark that follows none of them."""
        pairs = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        if any(x[1] == SPACE and x[0] != SPACE for x in pairs):
            return re.compile(".+", re.S)
        inner = {c for x in pairs for c in x}
        alone = {c for c in "\n\t\r" if c not in inner}
        after_word = {x[1] for x in pairs if x[0].isalnum()}
        marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") - after_word
        own, mark = (re.escape("".join(sorted(s))) for s in (alone, marks))
        other = f"[^{SPACE}{own}{mark}]+" + (f"|(?<![^\\W_])[{mark}]" if marks else "")
        parts = [f"[{own}]"] * bool(alone) + [f"{SPACE}*[^{SPACE}{own}](?:{other})*", f"{SPACE}+"]
        return re.compile("|".join(parts))

    def normalise(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def emit(self, piece: str) -> list[int]:
        """Output of an arc: the piece's id, or the byte pieces of a character."""
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def _fallback(self, char: str) -> int:
        """Number of a character that is no piece by itself, from now on in P."""
        self.names.append(char)
        self.emitted.append(np.array(self.emit(char), np.int32).tobytes())
        self.trie[char] = len(self.names) - 1
        return len(self.names) - 1

    def _merged(self, text: str) -> list[str]:
        """Characters merged by best score, leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _join(self, left: int, right: int) -> bool:
        """Is the junction's weight finite? Number 0 stands for a start."""
        if len(self.joins) >= KEEP_WORDS:
            self.joins.clear()
        a, b = self.names[left], self.names[right]
        found = self.joins[left << 32 | right] = self._merged(a + b) == ([a, b] if left else [b])
        return found

    def _path_bpe(self, word: str) -> bytes:
        """Depth-first, longest arcs first: all finite paths weigh nought and
        a place has one path at most, so the first that arrives is shortest
        and a place that failed once is closed."""
        trie, joins, n = self.trie, self.joins, len(word)
        closed, path = bytearray(n + 1), []
        i = left = 0
        while i < n:
            arcs = []
            j, piece = i + 1, trie.get(word[i], -1)
            if piece < 0:  # no piece by itself
                piece = self._fallback(word[i])
            while piece is not None:
                if piece > 0:
                    arcs.append((j, piece))
                j += 1
                if j > n:
                    break
                piece = trie.get(word[i:j])
            while True:
                if not arcs:
                    closed[i] = 1
                    i, left, arcs, _ = path.pop()
                    continue
                j, piece = arcs.pop()
                if not closed[j]:
                    ok = joins.get(left << 32 | piece)
                    if self._join(left, piece) if ok is None else ok:
                        break
            path.append((i, left, arcs, piece))
            i, left = j, piece
        return b"".join([self.emitted[p[3]] for p in path])

    def _path_unigram(self, word: str) -> bytes:
        distance, last = [0.0] + [np.inf] * len(word), [""] * (len(word) + 1)
        for i in range(len(word)):
            for j in range(i + 1, min(len(word), i + self.longest) + 1):
                weight = self.score.get(word[i:j])
                if weight is None and j == i + 1:
                    weight = self.worst
                if weight is not None and distance[i] - weight < distance[j]:
                    distance[j], last[j] = distance[i] - weight, word[i:j]
        pieces, j = [], len(word)
        while j:
            pieces.append(last[j])
            j -= len(last[j])
        return np.array([k for p in pieces[::-1] for k in self.emit(p)], np.int32).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids on the shortest path through the composition with ``word``."""
        ids = self._path_bpe(word) if self.bpe else self._path_unigram(word)
        if len(word) <= KEEP_CHARS:
            if len(self.known) >= KEEP_WORDS:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        known = self.known
        return b"".join([known.get(w) or self._word(w) for w in self.words.findall(self.normalise(text))])

    def decode(self, ids) -> str:
        out = self.out
        raw = b"".join([out[k] for k in ids])
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors="replace")


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, decoded: bool = True) -> DataFrame:
    """``docs`` with n_tokens, token_ids and (unless switched off) the text
    decoded from them again. ``model`` is the file's content (its size is
    that of a vocabulary)."""
    added = ["n_tokens", "token_ids"] + ["decoded"] * decoded
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = Machine(shared.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                found = [np.frombuffer(machine.encode(t or ""), np.int32) for t in part.column(at).to_pylist()]
                sizes = np.array([len(f) for f in found], np.int64)
                flat = np.concatenate(found) if found else np.zeros(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                arrays = [*part.columns, pa.array(sizes), ids]
                if decoded:
                    arrays.append(pa.array([machine.decode(f.tolist()) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = StructType(list(docs.schema.fields)).add("n_tokens", LongType()).add("token_ids", ArrayType(IntegerType()))
    return arrow_map(docs, run, schema.add("decoded", StringType()) if decoded else schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    return encode(docs, load()).drop("text")
