"""SPLIT job: exact-size seeded splits.

The order is a seeded hash of the record id (``md5('<seed>:<id>')``), null
ids last. Sizes are exact for any ids: of rows with one id (or none) that a
border cuts through, the right number goes to either side, whichever rows
these are.

Without the rank (what the split job runs) nothing but sums is shuffled: the
hash at each border is found by radix selection (``borders``: rows are counted
by hash prefix, and only the prefixes that hold a border are counted again by
a longer one), and each row compares its hash with the two or three border
values. Where a border cuts through rows of one hash, only those are numbered
(``ranks.numbered``), partition by partition, so a hot id is no large task.

With the rank, rows are bucketed on the first hex characters of the hash
(4,096 buckets by default), bucket sizes are counted (partial aggregation),
their running offsets are computed on that small table and broadcast back (its
size is fixed by the bucket count), and each row's rank is its bucket offset
plus its row number inside the bucket. Null ids are numbered apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollout_tables.fixed_values import SPLIT_SEED, SPLITS_3WAY, SPLITS_4WAY
from rollout_tables.operators.ranks import numbered

HASH_CHARS = 32
RADIX_CHARS = (4, 8, HASH_CHARS)
NULL_HASH = "g"  # after all hex digits


def split_sizes_expr(total: F.Column, ratios: list[tuple[str, float]]) -> list[F.Column]:
    """D3: ``floor(n * r)`` in double arithmetic per split; the remainder
    goes to the first split."""
    floors = [F.floor(total * F.lit(float(r))) for _, r in ratios]
    rest = total - sum(floors[1:], F.lit(0)) - floors[0]
    return [floors[0] + rest] + floors[1:]


def split_hash(id_col: str, seed: int) -> Column:
    """The place of an id in the seeded order: 32 hex digits; null ids sort
    after all others."""
    return F.coalesce(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.lit(NULL_HASH))


@dataclass(frozen=True)
class Border:
    """The hash of the row with a wanted rank: ``before`` rows have smaller
    hashes, ``count`` rows have this one."""
    rank: int
    hash: str
    before: int
    count: int

    @property
    def cut(self) -> bool:
        """Whether the border lies between rows of one hash."""
        return self.rank < self.before + self.count


def borders(df: DataFrame, id_col: str, ratios: list[tuple[str, float]], seed: int = SPLIT_SEED) -> list[Border | None]:
    """The border that ends each split (None where no rows come before it).

    Radix selection: rows are counted by the first hex digits of their hash,
    then again, by more digits, only where a border lies. Each level reads the
    id column and brings 16 ** 4 counts (for each border) to the driver at
    most; beyond eight digits few hashes share a prefix (one in four billion
    of the distinct ids)."""
    hashes = df.select(split_hash(id_col, seed).alias("h"))
    ends, place, prefixes, last = None, {}, [], 0
    for chars in RADIX_CHARS:
        if last and chars < HASH_CHARS and all(n <= 16 ** RADIX_CHARS[0] for _, _, n in place.values()):
            continue  # few rows left: by the whole hash at once
        rows = hashes if ends is None else hashes.filter(F.substring("h", 1, last).isin(prefixes))
        got = rows.groupBy(F.substring("h", 1, chars).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        level = sorted((r["p"], r["n"]) for r in got)
        if ends is None:
            ends = list(accumulate(split_sizes(sum(n for _, n in level), ratios)))
            place = {rank: ("", 0, 0) for rank in ends if rank}
        place = {rank: _holding(level, rank, *at[:2]) for rank, at in place.items()}
        prefixes, last = sorted({p for p, _, _ in place.values()}), chars
    return [Border(rank, *place[rank]) if rank else None for rank in ends]


def _holding(level: list[tuple[str, int]], rank: int, prefix: str, before: int) -> tuple[str, int, int]:
    """The prefix below ``prefix`` that holds the row of this rank, the rows
    before it and its own."""
    for p, n in level:
        if p.startswith(prefix):
            if before + n >= rank:
                return p, before, n
            before += n
    raise RuntimeError("the table changed while its splits were drawn")


def split_sizes(total: int, ratios: list[tuple[str, float]]) -> list[int]:
    """D3 for a known number of rows."""
    floors = [int(total * r) for _, r in ratios]
    return [floors[0] + total - sum(floors), *floors[1:]]


def _by_borders(df: DataFrame, id_col: str, ratios: list[tuple[str, float]], seed: int) -> DataFrame:
    """Every row with its split, by comparison with the border hashes."""
    ends = borders(df, id_col, ratios, seed)
    h = split_hash(id_col, seed)

    def named(place, at):
        """The first split whose end is not before ``place``."""
        chain = F
        for (name, _), end in zip(ratios, ends):
            if end is not None:
                chain = chain.when(place <= F.lit(at(end)), F.lit(name))
        return F.lit(ratios[-1][0]) if chain is F else chain

    cut = {e.hash: e for e in ends if e is not None and e.cut}
    whole = df if not cut else df.filter(~h.isin(sorted(cut)))
    out = whole.withColumn("split", named(h, lambda e: e.hash))
    for key, e in cut.items():
        tied = numbered(df.filter(h == key), "_nth")
        rank = F.col("_nth") + F.lit(e.before)
        out = out.unionByName(tied.withColumn("split", named(rank, lambda e: e.rank)).drop("_nth"))
    return out


def assign_splits(df: DataFrame, id_col: str, ratios: list[tuple[str, float]] = SPLITS_3WAY,
                  seed: int = SPLIT_SEED, bucket_chars: int = 3, with_rank: bool = True) -> DataFrame:
    """Adds ``split`` (contiguous rank ranges in the order of
    ``ratios``) and, with ``with_rank``, ``split_rank`` (1-based position in
    the seeded order). ``bucket_chars`` sets the 16^n buckets of the ranked
    form: 3 (4,096) keeps buckets of about 250,000 rows per billion records;
    use 4 above about 10^10 records. Existing columns of these names are
    replaced; every row stays, null and repeated ids too."""
    df = df.drop("split", *(["split_rank"] if with_rank else []))
    if not with_rank:
        return _by_borders(df, id_col, ratios, seed)
    if not 1 <= bucket_chars <= 5:
        raise ValueError("bucket_chars must be 1 to 5: the bucket table (16 ** 5 rows at most) is broadcast")
    keyed = df.withColumn("_h", split_hash(id_col, seed)).withColumn("_bucket", F.substring("_h", 1, bucket_chars))
    counts = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_bucket")  # over the bucket table only (16^bucket_chars rows and one at most)
    offsets = (counts.withColumn("_offset", F.coalesce(
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_cnt").over(Window.partitionBy())).drop("_cnt"))

    def split_at(rank):
        chain, upper = None, F.lit(0)
        for (name, _), size in zip(ratios, split_sizes_expr(F.col("_total"), ratios)):
            upper = upper + size
            cond = rank <= upper
            chain = F.when(cond, F.lit(name)) if chain is None else chain.when(cond, F.lit(name))
        return chain

    def ranked(rows, nth):
        placed = rows.join(F.broadcast(offsets), "_bucket")
        placed = placed.withColumn("split_rank", (F.col("_offset") + nth).cast("long"))
        return placed.withColumn("split", split_at(F.col("split_rank"))).drop("_h", "_bucket", "_offset", "_total", "_nth")

    in_bucket = Window.partitionBy("_bucket").orderBy("_h", id_col)
    out = ranked(keyed.filter(F.col("_h") != NULL_HASH), F.row_number().over(in_bucket))
    if df.schema[id_col].nullable:
        out = out.unionByName(ranked(numbered(keyed.filter(F.col("_h") == NULL_HASH), "_nth"), F.col("_nth")))
    return out


def split_3way(df: DataFrame, id_col: str, **kw) -> DataFrame:
    """0.70 / 0.20 / 0.10 as sft_train / rl / test."""
    return assign_splits(df, id_col, SPLITS_3WAY, **kw)


def split_4way(df: DataFrame, id_col: str, **kw) -> DataFrame:
    """0.64 / 0.06 / 0.20 / 0.10 as sft_train / sft_val / rl / test."""
    return assign_splits(df, id_col, SPLITS_4WAY, **kw)


def size_report(assigned: DataFrame, ratios: list[tuple[str, float]] = SPLITS_3WAY) -> DataFrame:
    """Rows and percent of the total per split, in split order."""
    return size_report_of(assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n")), ratios)


def size_report_of(per: DataFrame, ratios: list[tuple[str, float]] = SPLITS_3WAY) -> DataFrame:
    """D6 from the rows of each split (``split``, ``n``), such as the file
    footers give (``sources.footers``)."""
    order = F.create_map(*[x for i, (name, _) in enumerate(ratios) for x in (F.lit(name), F.lit(i))])
    return (per.withColumn("pct", F.col("n") * F.lit(100.0) / F.sum("n").over(Window.partitionBy()))
            .withColumn("split_order", F.try_element_at(order, F.col("split")).cast("int")))
