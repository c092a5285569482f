"""REPORT job: advantages and metric rollups over rewarded rollouts.

Every aggregate here is a ``groupBy`` with map-side partial aggregation, so
a hot group (one prompt or one step holding a third of all rows) is
combined inside each task before the shuffle. Windows run only over
already-aggregated tables whose size is the number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollout_tables.fixed_values import (
    CHARS_PER_TOKEN, LOGGING_STEPS, MAX_NEW_TOKENS, TARGET_REWARD_GAIN_PER_1000_STEPS, TARGET_TOKENS,
)


def group_stats(scored: DataFrame, group_col: str = "prompt_id", reward_col: str = "reward") -> DataFrame:
    """I1, first step: mean, sample standard deviation and size per group."""
    return scored.groupBy(group_col).agg(
        F.avg(reward_col).alias("group_mean"), F.stddev_samp(reward_col).alias("group_std"),
        F.count(F.lit(1)).alias("group_size"))


def group_advantage(scored: DataFrame, group_col: str = "prompt_id", reward_col: str = "reward",
                    eps: float = 1e-4, stats: DataFrame | None = None) -> DataFrame:
    """``(r - mean) / (std + eps)`` within each prompt's group of
    completions (sample standard deviation); a group of one gets 0.0. Rows
    without a prompt are a group of their own.

    The statistics are joined back on the group key. AQE splits a hot group
    only if both sides of that join read an exchange directly, so at scale
    write ``group_stats`` to a table first and pass it as ``stats`` (the
    report job does)."""
    stats = group_stats(scored, group_col, reward_col) if stats is None else stats
    stats = stats.withColumnRenamed(group_col, "_group")
    out = scored.join(stats, F.col(group_col).eqNullSafe(F.col("_group")), "inner").drop("_group")
    adv = F.when(F.col("group_size") > 1,
                 (F.col(reward_col) - F.col("group_mean")) / (F.col("group_std") + F.lit(eps))).otherwise(F.lit(0.0))
    return out.withColumn("advantage", adv)


def _interval(step: Column, steps: int) -> Column:
    return (F.floor(step / steps) * steps).cast("long")


def complete_axis(per: DataFrame, steps: int, axis: str = "interval_start") -> DataFrame:
    """Every interval from the first to the last one of ``per``, those without
    rows too (their values are null, a count ``n`` is 0)."""
    ends = per.agg(F.min(axis).alias("a"), F.max(axis).alias("b")).filter(F.col("a").isNotNull())
    whole = ends.select(F.explode(F.sequence("a", "b", F.lit(steps).cast("long"))).alias(axis))
    out = whole.join(per, axis, "left").select(per.columns)
    return out.fillna(0, ["n"]) if "n" in per.columns else out


def reward_by_interval(scored: DataFrame, logging_steps: int = LOGGING_STEPS, complete: bool = False) -> DataFrame:
    """Mean and standard deviation of the reward per logging interval;
    with ``complete`` the intervals without rewards are listed too (then rows
    without a step are left out)."""
    per = (scored.groupBy(_interval(F.col("step"), logging_steps).alias("interval_start"))
           .agg(F.count(F.lit(1)).alias("n"), F.avg("reward").alias("reward"),
                F.stddev_samp("reward").alias("reward_std")))
    return complete_axis(per.filter(F.col("interval_start").isNotNull()), logging_steps) if complete else per


def reward_trend(scored: DataFrame, interval_steps: int = 100,
                 target_per_1000: float = TARGET_REWARD_GAIN_PER_1000_STEPS, complete: bool = False) -> DataFrame:
    """Mean reward per interval and its change since the last interval
    that has rewards, scaled from their true distance to 1,000 steps, against
    the target gain. Rows without a step belong to no interval. With
    ``complete`` the intervals without rewards are listed too."""
    per = scored.filter(F.col("step").isNotNull()).groupBy(_interval(F.col("step"), interval_steps).alias("interval_start")).agg(
        F.avg("reward").alias("mean_reward"))
    w = Window.orderBy("interval_start")  # over the interval table: one row per interval
    steps = F.col("interval_start") - F.lag("interval_start").over(w)
    delta = (F.col("mean_reward") - F.lag("mean_reward").over(w)) * F.lit(1000.0) / steps
    out = (per.withColumn("gain_per_1000_steps", delta)
           .withColumn("meets_target", F.col("gain_per_1000_steps") >= F.lit(target_per_1000)))
    return complete_axis(out, interval_steps) if complete else out


def reward_slope(scored: DataFrame, target_per_1000: float = TARGET_REWARD_GAIN_PER_1000_STEPS) -> DataFrame:
    """I6 over all steps: the least-squares slope of the reward on the step
    (of single rollouts, so distances and counts are the true ones) per 1,000
    steps, by category and overall (category null). Moments are summed in the
    tasks; null where all rewards are at one step."""
    known = scored.filter(F.col("step").isNotNull() & F.col("reward").isNotNull())
    out = known.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
                                       (F.regr_slope("reward", F.col("step").cast("double")) * 1000).alias("slope_per_1000_steps"))
    return out.withColumn("meets_target", F.col("slope_per_1000_steps") >= F.lit(target_per_1000))


def exact_quantiles(df: DataFrame, value_col: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact nearest-rank quantiles (smallest value whose cumulative count
    reaches ``ceil(p * n)``) from a value histogram: the histogram is a
    partial aggregation whose size is the number of distinct values, and
    only it is windowed, never the rows."""
    by = by or []
    hist = df.groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*by).orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_cum", F.sum("_cnt").over(w)).withColumn(
        "_n", F.sum("_cnt").over(Window.partitionBy(*by)))
    aggs = [F.min(F.when(F.col("_cum") >= F.ceil(F.col("_n") * F.lit(p)), F.col(value_col))).alias(
        f"p{int(round(p * 100))}") for p in probs]
    return hist.groupBy(*by).agg(*aggs)


def completion_lengths(rollouts: DataFrame, max_new_tokens: int = MAX_NEW_TOKENS,
                       target: tuple[int, int] = TARGET_TOKENS) -> DataFrame:
    """Completion length statistics in approximate tokens (characters /
    4): min, mean, max, exact median and 90th percentile of the character
    length, completions in the 20-60 token target, and completions at the cap.

    Everything is computed from the length histogram (a partial aggregation
    sized by the number of distinct lengths) in one aggregation."""
    chars = F.length(F.coalesce(F.col("completion"), F.lit(""))).alias("chars")
    hist = rollouts.groupBy(chars).agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.orderBy("chars")  # over the histogram, one row per distinct length
    hist = (hist.withColumn("cum", F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("total", F.sum("cnt").over(Window.partitionBy())))
    tokens = F.col("chars") / F.lit(CHARS_PER_TOKEN)

    def quantile(p):
        return F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * F.lit(p)), F.col("chars"))) / F.lit(CHARS_PER_TOKEN)

    return hist.agg(
        F.sum("cnt").alias("n"),
        (F.min("chars") / F.lit(CHARS_PER_TOKEN)).alias("min_tokens"),
        (F.sum(F.col("chars") * F.col("cnt")) / F.sum("cnt") / F.lit(CHARS_PER_TOKEN)).alias("mean_tokens"),
        (F.max("chars") / F.lit(CHARS_PER_TOKEN)).alias("max_tokens"),
        F.sum(F.when((tokens >= target[0]) & (tokens <= target[1]), F.col("cnt")).otherwise(0)).alias("n_in_target"),
        F.sum(F.when(tokens >= max_new_tokens, F.col("cnt")).otherwise(0)).alias("n_at_cap"),
        quantile(0.5).alias("p50_tokens"),
        quantile(0.9).alias("p90_tokens"))


def reward_by_category(scored: DataFrame) -> DataFrame:
    """I4: per-category reward table with a grand-total row (category null)."""
    return scored.rollup("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_samp("reward").alias("reward_std"),
        F.min("reward").alias("min_reward"),
        F.max("reward").alias("max_reward"),
        F.avg("reward_raw").alias("mean_reward_raw"),
        F.count_if(F.col("penalty") > 0).alias("n_penalised"),
        F.count_if(F.col("json_state") == "object").alias("n_json"))


def weighted_report(weighted: DataFrame) -> DataFrame:
    """G10 report: per category and overall, the weight-averaged reward."""
    return weighted.rollup("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("reward").alias("mean_reward"),
        (F.sum(F.col("weight") * F.col("reward")) / F.sum("weight")).alias("weighted_mean_reward"))


def completion_sample(rollouts: DataFrame, batch_col: str = "step", order_col: str = "rollout_id",
                      min_chars: int = 100, max_chars: int = 200) -> DataFrame:
    """The first completion of each batch when it is longer than 100
    characters, cut to 200 (the log sample). ``min_by`` is a partial
    aggregate, so a large batch is reduced inside each task."""
    first = rollouts.groupBy(batch_col).agg(
        F.min(order_col).alias(order_col),
        F.min_by("completion", F.col(order_col)).alias("completion"))
    return (first.filter(F.length("completion") > min_chars)
            .select(batch_col, order_col, F.substring("completion", 1, max_chars).alias("sample")))
