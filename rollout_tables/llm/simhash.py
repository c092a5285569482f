"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are cut into two 32-bit segments. Two fingerprints at
most 3 bits apart agree in one segment up to 1 bit (3 = 1 + 2), so each is
posted under its own segment values and probes the Hamming ball of radius 1
around them (33 keys a segment). Whatever meets under a key is verified on the
whole 64 bits. Every bucket gives the links of a spanning star, not all pairs,
so a large group of copies stays linear; the components come from alternating
large-star and small-star rounds over those links.

A bucket with more comparisons than ``BUCKET_PAIRS`` is not worked on in one
task: its fingerprints are posted again under the halves of their other
segment, where two that are at most 3 bits apart agree in one half up to 1 bit.
Of those, 16 bits are open, so at most 65,536 fingerprints are posted under one
key, however many the table holds.

Defined cases: null and empty texts have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; rows with equal
doc_id or equal text are rows of their own; a null doc_id gets a fingerprint
and takes part in links, but is never a component's smallest id (a component
with null ids only has a null component_id); empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_tables.llm.common import arrow_map, scratch, table

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET_PAIRS = 1 << 24  # comparisons of a bucket in one task
PIECE_BYTES = 4 << 20
SPACES = b" \t\n\x0b\x0c\r"
# byte value -> its 8 bits, most significant first, in the 8 byte lanes of a word
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _pieces(text: bytes):
    """A long text in parts of bounded size, cut at white space."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _digests(text: bytes, k: int):
    """Big-endian XXH64 digests of the word shingles, part by part."""
    digest = xxhash.xxh64_digest
    carried: list[bytes] = []
    seen = False
    for piece in _pieces(text.lower()):
        words = carried + piece.split()
        if len(words) < k:
            carried = words
            continue
        seen = True
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        yield b"".join([digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[k - 1:])])
        carried = words[len(words) - k + 1:] if k > 1 else []
    if not seen and carried:
        yield digest(b" ".join(carried), SEED)


def _bit_counts(digests: bytes) -> np.ndarray:
    """How often each of the 64 bits, most significant first, is set."""
    lanes = LANES[np.frombuffer(digests, np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # a lane counts to 255
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, k: int = SHINGLE) -> bytes:
    """The 8 big-endian bytes of a text's fingerprint."""
    counts, n = np.zeros(64, np.int64), 0
    for digests in _digests((text or "").encode(), k):
        counts += _bit_counts(digests)
        n += len(digests) // 8
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number), mark (a hash of
    the text)."""
    def run(batches):
        for batch in batches:
            raw = b"".join(fingerprint(t, k) for t in batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64)), batch.column(2)], ["doc_id", "fp", "mark"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark")), run, "doc_id long, fp long, mark long")


def _star_edges(fps: np.ndarray, own: np.ndarray, max_bits: int):
    """Links (fp, smallest fp of its group) of the fingerprints under one key.
    A link is verified between a posted and a probing fingerprint; blocks
    bound the memory of a large bucket."""
    posted = np.unique(fps[own])
    probing = np.unique(fps)
    parent = np.arange(len(probing))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = max(1, (1 << 20) // len(probing))
    for a in range(0, len(posted), step):
        block = posted[a:a + step]
        near = np.bitwise_count((block[:, None] ^ probing[None, :]).view(np.uint64)) <= max_bits  # of signed numbers it counts the absolute value's bits
        at = np.searchsorted(probing, block)
        # every probing value joins the first posted one it matches in this
        # block; posted ones that share a probing value are joined through it
        for i, j in zip(*np.nonzero(near)) if near.sum() < 4 * len(probing) else _reduced(near):
            a_root, b_root = find(at[i]), find(j)
            if a_root != b_root:
                parent[max(a_root, b_root)] = min(a_root, b_root)
    roots = np.array([find(i) for i in range(len(probing))])
    linked = roots != np.arange(len(probing))
    return probing[linked], probing[roots[linked]]


def _reduced(near: np.ndarray):
    """For a dense block of links, a spanning subset of the same components:
    rows are merged through the columns that they share, then each column
    keeps one row."""
    seen = np.full(near.shape[1], -1)
    for i in range(near.shape[0]):
        columns = np.flatnonzero(near[i])
        known = seen[columns]
        for other in np.unique(known[known >= 0]):
            j = columns[known == other][0]
            yield i, j
        new = columns[known < 0]
        for j in new:
            yield i, j
        seen[new] = i


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b), a > b: a spanning set of all
    pairs within ``max_bits`` (at most 3: one flip a segment)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius 1 find pairs up to 3 bits apart")
    flips = F.expr("transform(sequence(-1, 31), i -> if(i < 0, 0L, shiftleft(1L, i)))")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    posts = (fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("segment"), low.alias("value")), F.struct(F.lit(1).alias("segment"), high.alias("value")))).alias("s"))
             .select("fp", "s.segment", "s.value", F.explode(flips).alias("flip"))
             .select("fp", (F.col("segment").cast("long") * F.lit(1 << 32) + F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), (F.col("flip") == 0).alias("own")))
    first = scratch(_meet(posts, max_bits, BUCKET_PAIRS), "simhash-met")
    found, large = first.filter("key is null").select("a", "b"), first.filter("key is not null")
    if not large.isEmpty():
        other = F.when(F.col("key") >= F.lit(1 << 32), F.col("a").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("a", 32))
        halves = F.array(F.struct(F.lit(0).alias("half"), other.bitwiseAND(F.lit(0xFFFF)).alias("value")), F.struct(F.lit(1).alias("half"), F.shiftright(other, 16).alias("value")))
        again = (large.select(F.col("a").alias("fp"), "key", "own", F.explode(halves).alias("s"))
                 .select("fp", "key", "own", "s.half", "s.value", F.explode(F.expr("transform(sequence(-1, 15), i -> if(i < 0, 0L, shiftleft(1L, i)))")).alias("flip"))
                 .select("fp", F.xxhash64("key", "half", F.col("value").bitwiseXOR(F.col("flip"))).alias("key"), (F.col("own") & (F.col("flip") == 0)).alias("own")))
        found = found.unionByName(_meet(again, max_bits, None).select("a", "b"))
    return found.distinct()


def _meet(posts: DataFrame, max_bits: int, most: int | None) -> DataFrame:
    """posts (fp, key, own: is it posted or does it probe) -> links (a, b) of
    each key's bucket, with a null key; the rows of buckets that need more than
    ``most`` comparisons come back as they are (a, key, own). Rows posted come
    first, so a bucket is known to be large before it is held."""
    def bucket(parts):
        fps, own = (np.concatenate(x) for x in zip(*parts))
        return _star_edges(fps, own, max_bits) if own.any() and len(fps) > 1 else (fps[:0], fps[:0])

    def whole(keys, fps, own):
        """The links of buckets that are complete and small, and the others' rows."""
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begin, len(keys)])
        posted = np.add.reduceat(own.astype(np.int64), begin)
        big = posted * size > most if most is not None else np.zeros(len(size), bool)
        pairs = [_star_edges(fps[b:b + n], own[b:b + n], max_bits) for b, n in zip(*(x[(size > 1) & (posted > 0) & ~big] for x in (begin, size)))]
        rows = np.repeat(big, size)
        return pairs, (keys[rows], fps[rows], own[rows])

    def made(pairs, rows):
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.bool_())], names)
        keys, fps, own = rows
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(keys), pa.array(own)], names)

    def run(batches):
        key, held, large = None, [], False  # the bucket that may go on in the next batch
        for batch in batches:
            keys, fps, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "own"))
            if not len(keys):
                continue
            goes_on = np.searchsorted(keys, key, "right") if key is not None else 0
            if goes_on:
                held.append((fps[:goes_on], own[:goes_on]))
            if held and most is not None and sum(int(o.sum()) for _, o in held) * sum(len(f) for f, _ in held) > most:
                large = True
            if large and held:
                yield from made([], (np.full(sum(len(f) for f, _ in held), key), *(np.concatenate(x) for x in zip(*held))))
                held = []
            if goes_on == len(keys):
                continue
            if held:
                yield from made([bucket(held)], (keys[:0], fps[:0], own[:0]))
            last = np.searchsorted(keys, keys[-1])
            if last > goes_on:
                yield from made(*whole(keys[goes_on:last], fps[goes_on:last], own[goes_on:last]))
            last = max(last, goes_on)
            key, held, large = keys[-1], [(fps[last:], own[last:])], False
        if held:
            pairs, rows = whole(np.full(sum(len(f) for f, _ in held), key), *(np.concatenate(x) for x in zip(*held)))
            yield from made(pairs, rows)

    names = ["a", "b", "key", "own"]
    met = posts.repartition("key").sortWithinPartitions("key", F.desc("own"))
    return arrow_map(met.select("key", "fp", "own"), run, "a long, b long, key long, own boolean")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Links (a, b) -> (node, root): the smallest node reachable, for every
    node that has a link. Alternates large-star and small-star rounds until
    the links no longer change; each round is written to the shared folder."""
    def digest(df):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).head()
        return r.n, r.h

    now = scratch(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before, state = None, digest(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written first, so that the join to a star's centre can be split
        least = scratch(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), name + "-least")
        large = (both.join(least, F.col("a") == F.col("u")).filter("b > a")
                 .select(F.col("b").alias("a"), F.least("m", "u").alias("b")).filter("a <> b").distinct())
        large = scratch(large, name + "-large")
        least = scratch(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), name + "-least")
        small = large.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = scratch(small.filter("a <> b").distinct(), name)
        before, state = state, digest(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, mark, fp, root (a fingerprint that names the component) and
    component_id (smallest doc_id reachable) for every row."""
    rows = scratch(fingerprints(docs, k), "simhash-fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits), "simhash-links")
    rooted = scratch(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    smallest = scratch(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-smallest")
    by_fp = rooted.select(F.col("fp").alias("own_fp"), "root").join(smallest, "root")
    return rows.join(by_fp, F.col("fp") == F.col("own_fp")).select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component with all its columns: the one of the smallest
    doc_id (null last; ties: by a hash of the text), once if it is repeated."""
    rows = scratch(near_duplicates(docs, k, max_bits).groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n")), "simhash-rows")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("r")).select(F.col("r.doc_id").alias("__kept_id"), F.col("r.mark").alias("__kept_mark"), F.col("r.n").alias("__kept_n"))
    first = scratch(first, "simhash-kept")
    keyed = docs.withColumn("__mark", F.xxhash64(F.col("text").cast("string"))).withColumn("__id", F.col("doc_id").cast("long"))
    same = F.col("__id").eqNullSafe(F.col("__kept_id")) & (F.col("__mark") == F.col("__kept_mark"))
    kept = keyed.join(first.filter("__kept_n = 1"), same, "left_semi")
    repeated = first.filter("__kept_n > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["__id", "__mark"]))
    return kept.drop("__mark", "__id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
