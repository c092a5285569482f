"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, ``POSTED`` of
``PIVOTS`` vectors of a bounded sample (``SAMPLE``), no two of which are nearly
the same; this prefix of its permutation is computed once and written. The
index is cut into shards of bounded size by a hash of the id. A shard keeps one
inverted file per pivot, with the vectors that have it in their prefix and the
place it has there. A query reads the files of its own ``ASKED`` nearest pivots
only. Candidates are what these hold, ranked by the footrule distance of the
prefixes (a pivot missing from one counts as just behind its end; up to terms
that are the same for all, each shared pivot adds the places behind the later
of its two). The nearest ``SHARE`` of a shard, ``RERANKED`` times k at least,
is reranked by the exact inner product, and shards' best are merged. Queries
are broadcast in blocks of bounded size, so the query set may grow with the
table. Nothing depends on the number of cores.

For inner products of vectors of different length, all are lifted onto one
sphere by an extra component (nought for queries), which keeps the order.
Equal vectors are indexed once, under their smallest id, and expanded at the
end: of a vector, only its k + 1 smallest ids can be among k nearest.

Defined cases: a vector takes no part if it or its vec_id is null, if it is
all zeros, holds null or non-finite components, or has not the table's most
frequent length (ties: the shorter). Of rows with one vec_id the smallest
vector counts. With fewer candidates than k all are returned; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollout_tables.llm.common import scratch, table

K = 20
QUERY_STEP = 20
PIVOTS = 1024
SAMPLE = 4096
APART = 0.8  # largest cosine between pivots, while others are left
POSTED = 96
ASKED = 48
SHARE = 0.05
RERANKED = 16
SHARD_ROWS = 25_000
BLOCK_QUERIES = 16_384
SALTS = 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the vectors that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0)))
    return scratch(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("size", F.size("v")), "ann-vectors")


def _matrix(column, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each row, nearest first (ties: the first pivot)."""
    near = -(x @ pivots.T)
    n = min(n, len(pivots))
    some = np.sort(np.argpartition(near, n - 1, axis=1)[:, :n], axis=1) if n < len(pivots) else np.broadcast_to(np.arange(n), near.shape)
    order = np.argsort(np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n rows, in order, that are not near an earlier chosen one; then
    the rest in order. A crowd of near-equal vectors gives one pivot."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    nearest_chosen = np.full(len(sample), -1.0)
    chosen: list[int] = []
    for i in range(len(sample)):
        if len(chosen) < n and nearest_chosen[i] <= APART:
            chosen.append(i)
            np.maximum(nearest_chosen, unit @ unit[i], out=nearest_chosen)
    rest = np.setdiff1d(np.arange(len(sample)), chosen)[:n - len(chosen)]
    return sample[np.r_[np.array(chosen, np.int64), rest]]


def inverted_files(prefixes: np.ndarray, n_pivots: int):
    """(begin, rows, places): the rows with pivot p in their prefix, and its
    place there, stand at begin[p]:begin[p + 1]."""
    flat = prefixes.ravel()
    order = np.argsort(flat, kind="stable")
    return np.searchsorted(flat[order], np.arange(n_pivots + 1)), order // prefixes.shape[1], order % prefixes.shape[1]


def search_shard(ids, x, prefixes, n_pivots, query_ids, queries, asked, k):
    """(query, id, score) of each query's k best among the candidates of a shard."""
    begin, rows, places = inverted_files(prefixes, n_pivots)
    behind = max(prefixes.shape[1], asked.shape[1])
    take = min(len(ids), max(RERANKED * k, int(np.ceil(SHARE * len(ids)))))
    found = []
    for q in range(len(queries)):
        read = [slice(begin[p], begin[p + 1]) for p in asked[q]]
        at = np.concatenate([rows[s] for s in read])
        later = np.concatenate([np.maximum(places[s], place) for place, s in enumerate(read)])
        shared = np.bincount(at, weights=behind - later, minlength=len(ids))
        near = np.argpartition(-shared, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
        met = near[shared[near] > 0]
        # files that hold too few: any other vectors make up for them
        near = met if len(met) >= min(k, len(ids)) else near
        score = (x[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -score))[:k]
        found.append((np.full(len(best), query_ids[q]), ids[near][best], score[best]))
    return [np.concatenate(c) for c in zip(*found)]


def nearest(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector whose
    id is divisible by ``query_step``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    most = rows.groupBy("size").count().orderBy(F.desc("count"), "size").head()
    size = most["size"] if most else 0
    rows = rows.filter(F.col("size") == size).drop("size")
    distinct = scratch(rows.groupBy("v").agg(F.min("vec_id").alias("rep")), "ann-distinct")
    members = scratch(rows.join(distinct.withColumnRenamed("v", "d"), F.col("v") == F.col("d")).select("vec_id", "rep"), "ann-members")
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).head()
    longest = facts.longest or 0.0

    def lift(x):
        return np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))]

    pivots = choose_pivots(lift(_matrix(distinct.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("v").toArrow().column("v"), size)))
    asked = members.filter(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q"))
    questions = scratch(distinct.join(asked.select(F.col("q").alias("rep")).distinct(), "rep"), "ann-queries")
    blocks = max(1, -(-questions.count() // BLOCK_QUERIES))
    n_pivots = len(pivots)
    shared_pivots = spark.sparkContext.broadcast(pivots)

    def permute(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            prefixes = nearest_pivots(lift(x), shared_pivots.value, POSTED).astype(np.int16) if len(x) else np.zeros((0, 1), np.int16)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("v"), pa.array(list(prefixes), pa.list_(pa.int16()))], ["rep", "v", "prefix"])

    posted = scratch(distinct.select("rep", "v").mapInArrow(permute, "rep long, v array<double>, prefix array<short>"), "ann-index")
    shards = max(1, -(-facts.n // SHARD_ROWS))
    index = posted.repartition(shards, "rep")

    def search(block):
        held = questions.filter(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == block).toArrow()
        query_ids = held.column("rep").to_numpy()
        queries = _matrix(held.column("v"), size)
        asked = nearest_pivots(np.c_[queries, np.zeros(len(queries))], pivots, ASKED) if len(queries) else np.zeros((0, 1), np.int64)
        shared = spark.sparkContext.broadcast((query_ids, queries, asked))

        def run(batches):
            query_ids, queries, asked = shared.value
            held = [(b.column("rep").to_numpy(zero_copy_only=False), _matrix(b.column("v"), size), _matrix(b.column("prefix"), min(POSTED, n_pivots))) for b in batches if b.num_rows]
            if not held or not len(query_ids):
                return
            ids, x, prefixes = (np.concatenate(part) for part in zip(*held))
            columns = search_shard(ids, x, prefixes, n_pivots, query_ids, queries, asked, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "rep", "score"])

        return index.mapInArrow(run, "q long, rep long, score double")

    best = search(0)
    for block in range(1, blocks):
        best = best.unionByName(search(block))
    in_order = [F.desc("score"), "vec_id"]
    top = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).filter(F.col("place") <= k + 1).select("q", F.col("rep").alias("found"), "score")
    some = members.withColumn("salt", F.pmod("vec_id", F.lit(SALTS)))
    for keys in (["rep", "salt"], ["rep"]):
        some = some.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    expanded = top.join(some.select("vec_id", "rep"), F.col("found") == F.col("rep")).select("q", "vec_id", "score")
    expanded = expanded.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(*in_order))).filter(F.col("place") <= k + 1)
    ranked = expanded.join(asked.withColumnRenamed("q", "of"), F.col("q") == F.col("of")).filter("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*in_order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
