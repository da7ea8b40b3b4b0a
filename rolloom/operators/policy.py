"""Policy-ratio diagnostics over logged token log-probabilities.

A token row is ``rank, seq_id, pos, logp_new, logp_old, logp_ref, advantage, mask``. The columns
are independent per token; sums go sequence, then rank, then overall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_KINDS = ("grpo", "bnpo", "dr_grpo", "dapo")


def token_logp(logits: Column, token: Column, temperature: float) -> Column:
    """log p(token) under the softmax of ``logits / temperature``; ``token`` is 0-based."""
    top = F.array_max(logits)
    total = F.aggregate(
        logits, F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / F.lit(float(temperature)))
    )
    return (F.get(logits, token.cast("int")) - top) / F.lit(float(temperature)) - F.log(total)


def ratios(df: DataFrame, eps_low: float, eps_high: float) -> DataFrame:
    """Add ``ratio`` = exp(new - old) (1 where old is missing) and ``clipped``."""
    ratio = F.coalesce(F.exp(F.col("logp_new") - F.col("logp_old")), F.lit(1.0))
    low, high = F.lit(1 - eps_low), F.lit(1 + eps_high)
    return df.withColumn("ratio", ratio).withColumn("clipped", F.least(F.greatest("ratio", low), high))


def token_loss(df: DataFrame, delta: float | None = None, beta: float = 0.0) -> DataFrame:
    """Add ``loss`` per token to ``ratios`` rows, and ``kl`` if ``beta`` is not zero."""
    ratio = F.col("ratio") if delta is None else F.least("ratio", F.lit(float(delta)))
    advantage = F.col("advantage")
    loss = -F.least(ratio * advantage, F.col("clipped") * advantage)
    if beta == 0.0:
        return df.withColumn("loss", loss)
    return with_kl(df).withColumn("loss", loss + F.lit(float(beta)) * F.col("kl"))


def with_kl(df: DataFrame) -> DataFrame:
    """Add ``kl`` = exp(ref - new) - (ref - new) - 1."""
    gap = F.col("logp_ref") - F.col("logp_new")
    return df.withColumn("kl", F.exp(gap) - gap - 1)


def mean_kl(df: DataFrame) -> DataFrame:
    """Masked mean of ``kl`` per rank, then the mean over ranks."""
    mask = F.col("mask").cast("double")
    per_rank = df.groupBy("rank").agg(F.try_divide(F.sum(F.col("kl") * mask), F.sum(mask)).alias("kl"))
    return per_rank.agg(F.avg("kl").alias("kl"))


def loss(
    df: DataFrame, kind: str, max_seq_len: int | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """The loss of each rank: ``rank, loss``.

    ``grpo`` averages the sequences' masked means; ``bnpo`` divides the total by the tokens;
    ``dr_grpo`` by sequences times ``max_seq_len``; ``dapo`` by the global number of
    completion tokens over the number of ranks. Those two are read from ``totals``, one
    row of ``tokens`` and ``ranks``, if given; else they are counted over ``df``.
    """
    mask = F.col("mask").cast("double")
    per_seq = df.groupBy("rank", "seq_id").agg(F.sum(F.col("loss") * mask).alias("loss"), F.sum(mask).alias("mask"))
    return reduce_losses(per_seq, kind, max_seq_len, totals)


def reduce_losses(
    per_seq: DataFrame, kind: str, max_seq_len: int | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """``loss`` from sequences' sums: ``rank, seq_id, loss`` (masked sum) and ``mask`` (tokens).

    All kinds come from these sums, so a caller who wants several computes the sequences once.
    """
    if kind not in LOSS_KINDS:
        raise ValueError(f"unknown loss type: {kind}")
    at_least_one = F.greatest(F.sum("mask"), F.lit(1.0))
    if kind == "grpo":
        value = F.avg(F.col("loss") / F.greatest("mask", F.lit(1.0)))
    elif kind == "bnpo":
        value = F.sum("loss") / at_least_one
    elif kind == "dr_grpo":
        value = F.sum("loss") / (F.count(F.lit(1)) * F.lit(max_seq_len))
    else:
        value = F.sum("loss")
    per_rank = per_seq.groupBy("rank").agg(value.alias("loss"))
    if kind != "dapo":
        return per_rank
    if totals is None:
        totals = per_seq.agg(F.sum("mask").alias("tokens"), F.count_distinct("rank").alias("ranks"))
    return (
        per_rank.withColumn("_tokens", totals.select("tokens").scalar())
        .withColumn("_ranks", totals.select("ranks").scalar())
        .select("rank", F.try_divide(F.col("loss"), F.col("_tokens") / F.col("_ranks")).alias("loss"))
    )


def clip_stats(df: DataFrame, eps_low: float, eps_high: float) -> DataFrame:
    """Masked shares of clipped tokens per rank, reduced over ranks to one row."""
    mask = F.col("mask").cast("double")
    low = (F.col("ratio") < 1 - eps_low) & (F.col("advantage") < 0)
    high = (F.col("ratio") > 1 + eps_high) & (F.col("advantage") > 0)

    def share(flag: Column) -> Column:
        return F.try_divide(F.sum(F.when(flag, mask).otherwise(0.0)), F.sum(mask))

    per_rank = df.groupBy("rank").agg(
        share(low).alias("low"), share(high).alias("high"), share(low | high).alias("region")
    )
    return per_rank.agg(
        F.avg("low").alias("low_mean"),
        F.min("low").alias("low_min"),
        F.avg("high").alias("high_mean"),
        F.max("high").alias("high_max"),
        F.avg("region").alias("region_mean"),
    )
