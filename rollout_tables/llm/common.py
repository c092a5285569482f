"""Shared helpers of the training-data operators: Arrow-batch mapping over
documents, and numpy word splitting and hashing on whole UTF-8 texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.session import materialise

# Rows per Arrow batch and bytes of text worked on at once: together they
# bound a Python worker's memory (a single longer text is its own chunk).
BATCH_ROWS = 1000
CHUNK_BYTES = 2 << 20

MULT = 0x9E3779B97F4A7C15
MULT_INV = pow(MULT, -1, 1 << 64)

# word characters of the lower-casing word rule: digits, letters, all non-ASCII bytes
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
# everything but space, \t \n \v \f \r
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str):
    """The column of exactly this name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under the shared checkpoint folder and reads it back."""
    return materialise(df, name)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with batches of bounded row count."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int | None = None):
    """Slices of a batch holding at most ``limit`` text bytes, one row at least."""
    limit = limit or CHUNK_BYTES
    sizes = np.diff(utf8(batch.column(column))[1])
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and the index of each document's
    first word (n + 1). Words never cross document ends."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = MULT, inverse: int = MULT_INV) -> np.ndarray:
    """Mixed polynomial hash of values[starts:ends] for each range."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(inverse, len(values) + 1)[starts])


# one number for each byte at each of the first places of a word
_PLACES = 256
_AT_PLACE: dict[int, np.ndarray] = {}


def _numbers(at: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit number for each (place, byte), given as place * 256 + byte."""
    return mix((at.astype(np.uint64) + np.uint64(1)) * np.uint64(MULT) + np.uint64(salt * 0xD1342543DE82EF95 % (1 << 64)))


def _sums(letters: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of words whose bytes stand one after another: the sum of
    the numbers of a word's bytes at their places. Unlike a polynomial, whose
    differences are products that vanish modulo 2 ** 64 for some pairs of long
    words, the sum gives any two different words one hash with a chance of
    2 ** -64; what must be exact still compares the bytes."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(sizes) - sizes
    kind = np.int32 if len(letters) < 1 << 22 else np.int64
    at = (np.arange(len(letters), dtype=kind) - np.repeat(begin.astype(kind), sizes)) * kind(256) + letters
    if salt not in _AT_PLACE:
        _AT_PLACE[salt] = _numbers(np.arange(_PLACES * 256), salt)
    if sizes.max() <= _PLACES:
        numbers = _AT_PLACE[salt][at]
    else:
        numbers = _AT_PLACE[salt][np.minimum(at, _PLACES * 256 - 1)]
        far = np.flatnonzero(at >= _PLACES * 256)
        numbers[far] = _numbers(at[far], salt)
    return mix(np.add.reduceat(numbers, begin) + sizes.astype(np.uint64) * np.uint64(MULT))


def word_hashes(data, offsets, is_word, lower: bool, salt: int = 0):
    """(hashes, starts, ends, first) of the words of a chunk."""
    data = LOWER[data] if lower else data
    starts, ends, first = split_words(data, offsets, is_word)
    return _sums(data[is_word[data]], ends - starts, salt), starts, ends, first


def same_bytes(a, a_starts, b, b_starts, sizes) -> np.ndarray:
    """Whether a[a_starts:] and b[b_starts:] are equal over ``sizes`` bytes (1
    at least), pair by pair."""
    if not len(sizes):
        return np.zeros(0, bool)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
    return ~np.logical_or.reduceat(a[place + np.repeat(a_starts, sizes)] != b[place + np.repeat(b_starts, sizes)], begin)


def joined_words(data, starts, ends):
    """The words one after another with one space behind each, and where each
    begins (n + 1): any run of words is a slice."""
    sizes = ends - starts
    begin = np.r_[0, np.cumsum(sizes + 1)]
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[place + np.repeat(begin[:-1], sizes)] = data[place + np.repeat(starts, sizes)]
    return out, begin


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document index of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def crc_of_id(column: str = "doc_id"):
    """crc32 of an id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def refresh_n_chars(fields: list[str], arrays: list, text_at: int) -> list:
    """Sets an n_chars column to the length of the new text, where there is one."""
    import pyarrow.compute as pc
    if "n_chars" in fields:
        at = fields.index("n_chars")
        arrays[at] = pc.utf8_length(arrays[text_at]).cast(arrays[at].type)
    return arrays
