"""Training metrics, validation schedule, best steps and the checkpoint ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.operators.tokens import mask_sum
from rolloom.plans.ordered import running, step_chunk, top_rows


def length_stats(df: DataFrame, batch: Sequence[str]) -> DataFrame:
    """Mean, shortest and longest completion per batch, in unmasked tokens."""
    n = mask_sum("completion_mask")
    return df.groupBy(*batch).agg(
        F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length")
    )


def tokens_seen(df: DataFrame, run: Sequence[str], batch: str) -> DataFrame:
    """Padded prompt and completion tokens per batch and their running total in the run."""
    sizes = df.groupBy(*run, batch).agg(
        F.sum(F.size("prompt_mask") + F.size("completion_mask")).alias("tokens")
    )
    return running(sizes, run, [batch], step_chunk(batch), {"num_tokens": ("sum", F.col("tokens"))})


def terminated_stats(df: DataFrame, batch: Sequence[str], eos: int) -> DataFrame:
    """Share of completions without an unmasked EOS, and the lengths of the others (0 if none)."""
    length = mask_sum("completion_mask")
    ended = F.exists(
        F.arrays_zip(F.col("completion_ids").alias("id"), F.col("completion_mask").alias("on")),
        lambda t: (t["id"] == eos) & (t["on"] != 0),
    )
    done = F.when(ended, length)
    return df.groupBy(*batch).agg(
        (F.lit(1.0) - F.count(done) / F.count(F.lit(1))).alias("clipped_ratio"),
        F.coalesce(F.avg(done), F.lit(0.0)).alias("mean_terminated_length"),
        F.coalesce(F.min(done), F.lit(0)).alias("min_terminated_length"),
        F.coalesce(F.max(done), F.lit(0)).alias("max_terminated_length"),
    )


def window_sums(metrics: DataFrame, run: Sequence[str], logging_steps: int, mode: str = "train") -> DataFrame:
    """``total`` and ``n`` of each metric over every ``logging_steps`` steps: sums of parts can be added up. ``eval_`` is put before
    the names in evaluation. Steps count from 0."""
    name = F.concat(F.lit("eval_"), F.col("name")) if mode == "eval" else F.col("name")
    window = F.floor(F.col("step") / logging_steps)
    return metrics.groupBy(*run, window.alias("window"), name.alias("name")).agg(F.sum("value").alias("total"), F.count("value").alias("n"))


def add_sums(sums: DataFrame, run: Sequence[str]) -> DataFrame:
    """``window_sums`` of several parts as those of the whole."""
    return sums.groupBy(*run, "window", "name").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def mean_of_sums(sums: DataFrame, run: Sequence[str]) -> DataFrame:
    return sums.select(*run, "window", "name", F.try_divide("total", "n").alias("value"))


def window_means(metrics: DataFrame, run: Sequence[str], logging_steps: int, mode: str = "train") -> DataFrame:
    """Mean of each metric over every ``logging_steps`` steps, named as in ``window_sums``."""
    return mean_of_sums(window_sums(metrics, run, logging_steps, mode), run)


def recent(df: DataFrame, window: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each log window."""
    return top_rows(df, window, [F.col(c).desc() for c in order], n, "_rank").drop("_rank")


def external_metrics(metrics: DataFrame, external: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Append the entries of ``metrics`` maps in ``external`` to the long-form metrics."""
    long = external.select(*keys, F.explode("metrics").alias("name", "value"))
    return metrics.select(*keys, "name", "value").unionByName(long)


def completions_table(
    df: DataFrame, rewards: Sequence[str], order: Sequence[str], unique_prompts: bool = False
) -> DataFrame:
    """``step, prompt, completion`` and one column per reward name.

    Reads long rows ``step, sample_id, prompt, completion, reward_name, value``. With ``unique_prompts``
    the first row of each prompt in ``order`` within the step is kept.

    Texts are keys by their 16-byte addresses only; the texts themselves are shuffled once, for the samples that the table
    keeps, when they join it at the end.
    """
    address = lambda c: F.unhex(F.md5(F.col(c)))
    addressed = df.withColumn("_prompt", address("prompt")).withColumn("_completion", address("completion"))
    sample = ["step", "sample_id", "_prompt", "_completion"]
    narrow = addressed.drop("prompt", "completion")
    wide = (
        narrow.groupBy(*sample, *[o for o in order if o not in ("step", "sample_id")])
        .pivot("reward_name", list(rewards))
        .agg(F.first("value"))
    )
    columns = ["sample_id", "step", "prompt", "completion", *rewards]
    if unique_prompts:
        kept = ["sample_id", "_completion", *rewards]
        firsts = wide.groupBy("step", "_prompt").agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("_first"))
        wide = firsts.select("step", "_prompt", "_first.*")
    # null texts have null addresses: a struct is equal also where a field is null
    key = F.struct(*sample)
    texts = addressed.withColumn("_key", key)
    if unique_prompts:
        texts = texts.join(wide.select(key.alias("_key")), "_key", "left_semi")
    texts = texts.groupBy("_key").agg(F.first("prompt").alias("prompt"), F.first("completion").alias("completion"))
    return wide.withColumn("_key", key).join(texts, "_key").select(*columns)


def is_val_step(step: Column, every: int, last: Column) -> Column:
    """Evaluated steps: the one before training (-1), the last, and every n-th."""
    return (step == -1) | (step == last) | (F.pmod(step + 1, F.lit(every)) == 0)


def val_steps(df: DataFrame, every: int, total: int) -> DataFrame:
    return df.where(is_val_step(F.col("step"), every, F.lit(total - 1)))


def best_steps(scores: DataFrame, run: Sequence[str], mode: str) -> DataFrame:
    """Add ``improved`` (strictly above all earlier scores) and ``checkpoint_name``.

    Step -1 sets the bar but makes no checkpoint. Modes: ``single-best``, ``improvements``, ``none``.
    """
    if mode not in ("single-best", "improvements", "none"):
        raise ValueError(f"unknown checkpoint mode: {mode}")
    barred = running(
        scores, run, ["step"], step_chunk("step"), {"best_before": ("max", F.col("score"))}, include_current=False
    )
    improved = F.col("best_before").isNull() | (F.col("score") > F.col("best_before"))
    name = {
        "single-best": F.lit("model_checkpoint_best"),
        "improvements": F.concat(F.lit("model_checkpoint_step_"), F.col("step") + 1),
        "none": F.lit(None).cast("string"),
    }[mode]
    return barred.withColumn("improved", improved).withColumn(
        "checkpoint_name", F.when(F.col("improved") & (F.col("step") >= 0), name)
    )


def checkpoint_ledger(records: DataFrame, job: Sequence[str], tie: str = "global_step") -> DataFrame:
    """The latest record of each checkpoint name, and which one is the job's latest.

    A missing timestamp counts as the earliest; ties go to the larger ``tie`` value.
    """
    zero = F.lit(0).cast(records.schema["timestamp"].dataType)
    at = F.struct(F.coalesce("timestamp", zero).alias("t"), F.col(tie).alias("tie"))
    others = [c for c in records.columns if c not in (*job, "checkpoint_name")]
    per_name = records.groupBy(*job, "checkpoint_name").agg(
        F.max_by(F.struct(*others), at).alias("r"), F.max(at).alias("_at")
    )
    latest = per_name.groupBy(*job).agg(F.max_by("checkpoint_name", "_at").alias("last_checkpoint"))
    return (
        per_name.join(latest, list(job))
        .select(*job, "checkpoint_name", "r.*", "last_checkpoint")
        .withColumn("is_last", F.col("checkpoint_name") == F.col("last_checkpoint"))
    )


def attach_score(ledger: DataFrame) -> DataFrame:
    """Lift ``score`` and ``step_index`` out of the metadata map of each checkpoint."""
    return ledger.withColumns(
        {
            "score": F.try_element_at("metadata", F.lit("score")).cast("double"),
            "step_index": F.try_element_at("metadata", F.lit("step_index")).cast("int"),
        }
    )
