"""Sharding by a hypergeometric communication matrix: a uniform shuffle of all
rows into shards whose sizes are exact.

The rows are written once with the partition they were read in and a place
drawn at random within it (the local permutation). How many rows of each
partition go to each shard is then drawn, not counted: under a uniform
permutation these counts are a matrix with given row sums (partitions) and
column sums (shards), and each row of it, given the earlier ones, is
multivariate hypergeometric. A row's place in its partition falls into the
range of one shard; that is the exchange. Within a shard the rows are permuted
again by a second random key, which gives the slot.

The matrix is drawn down a tree. A node holds up to ``FANOUT`` neighbouring
partitions (or nodes) and the places left in each shard; it deals these to its
children one after another, and each child goes on by itself, so no task holds
more than ``FANOUT`` children, whatever the number of partitions. A single
count is drawn by inversion from the mode outwards, with weights relative to
the mode, so that no factorial is needed; the tails left out weigh less than
the last bit of the uniform number (Bernstein's bound).

The order within a shard is exact without one task a shard: rows fall into
buckets by the key's leading part, bucket sizes are counted and summed up, and
rows are numbered within their bucket. The number of buckets follows the rows.

Everything is DataFrame and SQL code. Law: ``rows`` (shard sizes at most one
apart). The method keeps no groups together: equal texts are dealt like any
others, so a large group of copies spreads evenly.

Defined cases: every row gets a place, repeated rows one each. A null text has
no bytes and the checksum of no bytes. Columns named like the added ones are
replaced; all others stay. An empty table gives an empty result. The draw
follows the seed and the partitions read: the same files under the same
settings give the same shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollout_tables.llm.common import named, scratch, table

SHARDS = 24
SEED = 42
FANOUT = 64
BUCKET_ROWS = 65_536


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(population: str, marked: str, draws: str, uniform: str) -> str:
    """SQL for one draw: how many of ``draws`` rows, taken without replacement
    from ``population``, are among the ``marked`` ones. ``uniform`` is in
    [0, 1)."""
    def up(k):  # weight of k + 1 relative to that of k
        return f"(h.marked - {k}) * 1D * (h.draws - {k}) / (({k} + 1D) * (h.rest + {k} + 1))"

    def down(k):  # weight of k - 1 relative to that of k
        return f"{k} * 1D * (h.rest + {k}) / ((h.marked - {k} + 1D) * (h.draws - {k} + 1))"

    above = "if(h.mode < h.top, sequence(h.mode + 1, h.top), array())"
    below = "if(h.mode > h.bottom, sequence(h.mode - 1, h.bottom), array())"

    def total(places, ratio):
        """Sum of the weights at ``places``, that of the mode being 1."""
        return (f"aggregate({places}, named_struct('w', {ratio('h.mode')}, 's', 0D), "
                f"(a, k) -> named_struct('w', a.w * {ratio('k')}, 's', a.s + a.w), a -> a.s)")

    def search(places, ratio, begin):
        """The place at which the summed weights pass the target, or null."""
        return (f"aggregate({places}, named_struct('w', {ratio('h.mode')}, 's', {begin}, 'at', CAST(NULL AS BIGINT)), (a, k) -> "
                f"named_struct('w', a.w * {ratio('k')}, 's', a.s + a.w, 'at', coalesce(a.at, if(g.target < a.s + a.w, k, NULL))), a -> a.at)")

    find = (f"if(g.target < 1, h.mode, coalesce({search(above, up, '1D')}, {search(below, down, '1D + g.above')}, h.mode))")
    found = let("g", f"named_struct('above', {total(above, up)}, 'below', {total(below, down)})",
                let("g", f"named_struct('above', g.above, 'target', {uniform} * (1 + g.above + g.below))", find))
    same = "'marked', h.marked, 'draws', h.draws, 'rest', h.rest"
    # the range looked at: nine standard deviations and some places more
    ranged = let("h", f"named_struct({same}, 'mode', h.mode, 'bottom', greatest(h.low, h.mode - h.reach), 'top', least(h.high, h.mode + h.reach))", found)
    centred = let("h", f"named_struct({same}, 'low', h.low, 'high', h.high, 'reach', CAST(ceil(9 * h.deviation) AS BIGINT) + 24, "
                       "'mode', least(h.high, greatest(h.low, h.middle)))", ranged)
    given = (f"named_struct('marked', {marked}, 'draws', {draws}, 'rest', {population} - {marked} - {draws}, "
             f"'low', greatest(0L, {draws} + {marked} - {population}), 'high', least({marked}, {draws}), "
             f"'middle', CAST(floor(({draws} + 1D) * ({marked} + 1D) / ({population} + 2D)) AS BIGINT), "
             f"'deviation', sqrt({draws} * 1D * {marked} / {population} * (1 - {marked} * 1D / {population}) "
             f"* ({population} - {draws}) / greatest({population} - 1, 1)))")
    return f"if({draws} = 0 OR {marked} = 0, 0L, if({marked} = {population}, {draws}, {let('h', given, centred)}))"


def uniform(seed: int, *parts: str) -> str:
    """SQL for a number in [0, 1) that follows from its arguments."""
    return f"shiftrightunsigned(xxhash64({seed}L, {', '.join(parts)}), 11) * {2.0 ** -53!r}D"


def _deal(seed: int, level: int) -> str:
    """SQL that deals ``places`` (left in each shard) to ``children`` (id, n):
    for each child its id and its rows by shard."""
    one = let("d", hypergeometric("b.pool", "s.left[i]", "b.need", uniform(seed, f"{level}", "c.id", "i")),
              "named_struct('need', b.need - d, 'pool', b.pool - s.left[i], 'out', concat(b.out, array(d)))")
    child = (f"aggregate(sequence(0, size(s.left) - 1), named_struct('need', c.n, 'pool', aggregate(s.left, 0L, (x, y) -> x + y), "
             f"'out', CAST(array() AS ARRAY<BIGINT>)), (b, i) -> {one}, b -> b.out)")
    step = let("o", child, "named_struct('left', zip_with(s.left, o, (x, y) -> x - y), 'out', concat(s.out, array(named_struct('id', c.id, 'places', o))))")
    empty = "CAST(array() AS ARRAY<STRUCT<id: BIGINT, places: ARRAY<BIGINT>>>)"
    return f"aggregate(children, named_struct('left', places, 'out', {empty}), (s, c) -> {step}, s -> s.out)"


def matrix(counts: DataFrame, shards: int, total: int, seed: int, fanout: int = FANOUT) -> DataFrame:
    """(id, places): rows of each partition by shard, given ``counts`` (id, n)
    with ids from 0. Shard sizes are ``total`` / ``shards``, the first ones
    larger by one where that leaves a rest."""
    spark = counts.sparkSession
    top = counts.agg(F.max("id")).first()[0] or 0
    depth = 1
    while fanout ** depth <= top:
        depth += 1
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.lit(total // shards) + F.when(i < total % shards, 1).otherwise(0))
    nodes = spark.range(1).select("id", sizes.cast("array<bigint>").alias("places"))
    for level in range(depth, 0, -1):
        below = counts.groupBy(F.expr(f"id DIV {fanout ** (level - 1)}").alias("id")).agg(F.sum("n").alias("n"))
        children = below.groupBy(F.expr(f"id DIV {fanout}").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("children"))
        dealt = nodes.join(children, "id").select(F.explode(F.expr(_deal(seed, level))).alias("d"))
        nodes = scratch(dealt.select("d.id", "d.places"), f"sharding-level{level}")
    return nodes


def _key(seed: int, *parts: str) -> Column:
    return F.expr(uniform(seed, *parts))


def shard_rows(df: DataFrame, shards: int = SHARDS, seed: int = SEED, fanout: int = FANOUT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows with ``shard`` (int, from 0) and ``slot`` (long, from 0 and
    without gaps in each shard)."""
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    # the partitions and the places in them are fixed by writing them: a lost task gives a new draw of its partition, whole
    read = df.select(F.struct(*[named(c) for c in kept] or [F.lit(0)]).alias("row"), F.spark_partition_id().cast("long").alias("part"), F.rand(seed).alias("key"))
    within = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    rows = scratch(read.sortWithinPartitions("key").select("row", "part", within), "sharding-rows")
    counts = scratch(rows.groupBy(F.col("part").alias("id")).agg(F.count(F.lit(1)).alias("n")), "sharding-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ends = F.expr("transform(places, (x, i) -> aggregate(slice(places, 1, i + 1), 0L, (a, b) -> a + b))")
    dealt = scratch(matrix(counts, shards, total, seed, fanout).select(F.col("id").alias("part"), ends.alias("ends")), "sharding-matrix")
    buckets = max(1, -(-total // (shards * bucket_rows)))
    passed = [(F.col("place") >= F.get(F.col("ends"), F.lit(i))).cast("int") for i in range(shards - 1)]
    shard = sum(passed, F.lit(0))

    def placed(*columns):
        key = _key(seed + 1, "part", "place")
        return rows.join(dealt, "part").select(*columns, shard.alias("shard"), key.alias("key")).withColumn(
            "bucket", F.floor(F.col("key") * buckets).cast("long"))

    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch(placed().groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", offset).drop("n"), "sharding-offsets")
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "part", "place")
    numbered = placed("row", "part", "place").withColumn("nth", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"]).select(*[F.col("row").getField(c).alias(c) for c in kept], "shard", (F.col("offset") + F.col("nth")).cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_rows(docs).withColumn("grown_shard", F.lit(None).cast("int"))
