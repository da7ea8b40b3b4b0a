"""Reward shaping, advantages, reward statistics and evaluation scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: added to the deviation before dividing by it.
SCALE_EPSILON = 1e-4


def soft_penalty(reward: Column, length: Column, soft: int, maximum: int) -> Column:
    """Shrink a positive reward linearly once the completion is longer than ``soft``."""
    shrink = F.lit(1.0) - (length - F.lit(soft)) / F.lit(float(maximum - soft))
    return F.when((length > soft) & (reward > 0), reward * shrink).otherwise(reward)


def advantages(
    df: DataFrame,
    group: Sequence[str],
    scale: bool,
    reward: str = "reward",
    name: str = "advantage",
    bounded: bool = False,
) -> DataFrame:
    """Reward minus the group's mean, optionally over its sample deviation.

    The statistics are pre-aggregated and joined back, so a large group never sits in
    one task. Where the size of the groups has been checked before, ``bounded=True``
    uses a window instead, which needs no second pass and keeps the partitioning.
    """
    mean, std = F.avg(reward), F.stddev_samp(reward)
    if bounded:
        window = Window.partitionBy(*group)
        stats = df.withColumns({"_mean": mean.over(window), "_std": std.over(window)})
    else:
        stats = df.join(df.groupBy(*group).agg(mean.alias("_mean"), std.alias("_std")), list(group))
    centred = F.col(reward) - F.col("_mean")
    if scale:
        centred = centred / (F.col("_std") + F.lit(SCALE_EPSILON))
    return stats.withColumn(name, centred).drop("_mean", "_std")


def reward_stats(df: DataFrame, group: Sequence[str], by: Sequence[str] = (), reward: str = "reward") -> DataFrame:
    """Mean of the group means and mean of the group sample deviations."""
    groups = df.groupBy(*by, *[g for g in group if g not in by]).agg(
        F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_std")
    )
    return groups.groupBy(*by).agg(F.avg("_mean").alias("reward"), F.avg("_std").alias("reward_std"))


def reward_means(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``rewards/<name>`` and its mean, leaving out the combined ``reward``."""
    return (
        long.where(F.col("reward_name") != "reward")
        .groupBy(*by, "reward_name")
        .agg(F.avg("value").alias("value"))
        .withColumn("reward_name", F.concat(F.lit("rewards/"), "reward_name"))
        .withColumnRenamed("reward_name", "name")
    )


def evaluate(df: DataFrame, metric: Column, failure_score: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean metric; rows whose metric is null (an error) count as ``failure_score``."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(metric, F.lit(float(failure_score)))).alias("score"))
