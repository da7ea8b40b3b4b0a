"""From traces of rollouts to fixed-size groups of samples.

Trace entries are long-form rows; a rollout is ``example_id, teacher_id, rollout_idx``
and an invocation is one entry of one predictor, numbered from 1 by ``inv_idx``.
Nothing here gathers a group into an array except ``nest_groups``, which first
proves that every group has the declared size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.plans.ordered import grouped_rank, has_crowded_key, seeded_hash

EXAMPLE = ["predictor", "example_id"]
ROLLOUT = ["predictor", "example_id", "teacher_id", "rollout_idx"]
GROUP = ["predictor", "example_id", "inv_idx"]


def invocations(traces: DataFrame, order: Sequence[str], chunk: Column | None) -> DataFrame:
    """Number the entries of each predictor within each rollout, in trace order. ``chunk`` as in ``grouped_rank``."""
    return grouped_rank(traces, ROLLOUT, order, chunk, "inv_idx").withColumn("inv_idx", F.col("inv_idx").cast("bigint"))


def trace_lengths(traces: DataFrame) -> DataFrame:
    """Invocations per predictor and rollout. Needs only the key columns of the traces, numbered or not."""
    return traces.groupBy(*ROLLOUT).agg(F.count(F.lit(1)).alias("_len"))


def drop_empty(inv: DataFrame, rollouts: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Drop (predictor, example) unless every rollout of the example invoked the predictor.

    ``rollouts`` lists all rollouts, also those without any entry. ``lengths``, if given, is
    ``trace_lengths`` of the unnumbered traces, which saves numbering them twice.
    """
    lengths = trace_lengths(inv) if lengths is None else lengths
    # Entries of a rollout that is not listed neither help nor harm.
    listed = lengths.join(rollouts.select(*ROLLOUT[1:]).distinct(), ROLLOUT[1:], "left_semi")
    reached = listed.groupBy(*EXAMPLE).agg(F.count(F.lit(1)).alias("_reached"))
    expected = rollouts.select(*ROLLOUT[1:]).distinct().groupBy("example_id").agg(F.count(F.lit(1)).alias("_expected"))
    complete = reached.join(expected, "example_id").where("_reached = _expected").select(*EXAMPLE)
    return inv.join(complete, EXAMPLE, "left_semi")


def align(
    inv: DataFrame, mode: str, strategy: str | None = None, seed: int = 0, lengths: DataFrame | None = None
) -> DataFrame:
    """Give the rollouts of an example equally many invocations.

    ``truncate`` cuts to the shortest; ``fill`` extends to the longest, repeating the last
    invocation (``strategy="max"``) or a seeded random own one (``"randint"``);
    ``ragged`` leaves the lengths as they are. ``lengths`` as in ``drop_empty``.
    """
    if mode == "ragged":
        return inv
    lengths = trace_lengths(inv) if lengths is None else lengths
    if mode == "truncate":
        shortest = lengths.groupBy(*EXAMPLE).agg(F.min("_len").alias("_min"))
        return inv.join(shortest, EXAMPLE).where("inv_idx <= _min").drop("_min")
    if mode != "fill" or strategy not in ("max", "randint"):
        raise ValueError(f"unknown alignment: {mode}, {strategy}")
    longest = lengths.groupBy(*EXAMPLE).agg(F.max("_len").alias("_max"))
    sized = lengths.join(longest, EXAMPLE)
    if strategy == "max":
        # The last invocation takes all slots from its own to the longest.
        slots = F.when(F.col("inv_idx") == F.col("_len"), F.sequence("inv_idx", "_max"))
        return (
            inv.join(sized, ROLLOUT)
            .withColumn("inv_idx", F.explode(F.coalesce(slots, F.array("inv_idx"))))
            .drop("_len", "_max")
        )
    # Each filler slot draws one of the rollout's own invocations (the first 8 hex digits are enough to choose among
    # any real trace length); an invocation then takes its own slot and those that drew it, in one pass over the rows.
    def drawn(slot: Column) -> Column:
        number = F.conv(F.substring(seeded_hash(seed, *ROLLOUT, slot), 1, 8), 16, 10).cast("bigint")
        return F.struct((F.pmod(number, F.col("_len")) + 1).alias("from"), slot.alias("slot"))

    places = F.when(F.col("_len") < F.col("_max"), F.transform(F.sequence(F.col("_len") + 1, F.col("_max")), drawn))
    own = F.transform(F.filter("_fill", lambda f: f["from"] == F.col("inv_idx")), lambda f: f["slot"].cast("bigint"))
    slots = F.concat(F.array(F.col("inv_idx").cast("bigint")), F.coalesce(own, F.array().cast("array<bigint>")))
    slots = slots.cast(T.ArrayType(inv.schema["inv_idx"].dataType))
    filled = inv.join(sized.withColumn("_fill", places), ROLLOUT).withColumn("inv_idx", F.explode(slots))
    return filled.drop("_len", "_max", "_fill")


def to_groups(aligned: DataFrame, bounded: bool = False) -> DataFrame:
    """Transpose: group g of an example holds the g-th invocation of every rollout.

    Adds the 0-based ``member``, counted in rollout order. ``bounded=True`` asserts
    that the number of rollouts per example has been checked, so that a group
    fits a plain window. Otherwise the rows of examples are counted, which needs no numbering and bounds the groups.
    """
    if bounded or not has_crowded_key(aligned, EXAMPLE):
        place = F.row_number().over(Window.partitionBy(*GROUP).orderBy("teacher_id", "rollout_idx"))
        return aligned.withColumn("member", place.cast("bigint") - 1)
    chunk = F.struct("teacher_id", F.floor(F.col("rollout_idx") / 1024).alias("part"))
    ranked = grouped_rank(aligned, GROUP, ["teacher_id", "rollout_idx"], chunk, "member")
    return ranked.withColumn("member", F.col("member") - 1)


def shaped_score(failed: Column, format_reward: Column, score: Column, format_failure_score: float) -> Column:
    """The reward of a sample; a format reward of zero counts as none."""
    on_failure = F.coalesce(F.nullif(format_reward, F.lit(0.0)), F.lit(float(format_failure_score)))
    return F.when(failed, on_failure).otherwise(score).cast("double")


def chat_samples(inv: DataFrame, format_failure_score: float) -> DataFrame:
    """Replace the trace columns by ``messages, completion, reward``.

    Reads ``messages`` (the prompt), ``failed``, ``completion_text`` (raw text of a failed parse),
    ``output_role``, ``output_text``, ``format_reward`` and ``score``.
    """
    completion = F.struct(
        F.when(F.col("failed"), F.lit("assistant")).otherwise(F.col("output_role")).alias("role"),
        F.when(F.col("failed"), F.col("completion_text")).otherwise(F.col("output_text")).alias("content"),
    )
    reward = shaped_score(F.col("failed"), F.col("format_reward"), F.col("score"), format_failure_score)
    return inv.withColumns({"completion": completion, "reward": reward}).drop(
        "completion_text", "output_role", "output_text", "format_reward", "score"
    )


def pad_groups(
    samples: DataFrame, group: Sequence[str], size: int, member: str = "member", bounded: bool = False
) -> DataFrame:
    """Fill short groups to ``size`` by repeating their members cyclically.

    Member i of n takes the slots i, i+n, i+2n ... below ``size``. ``bounded`` as in ``to_groups``.
    """
    n = F.count(F.lit(1))
    if bounded:
        counted = samples.withColumn("_n", n.over(Window.partitionBy(*group)))
    else:
        counted = samples.join(samples.groupBy(*group).agg(n.alias("_n")), list(group))
    slots = F.expr(f"sequence({member}, greatest({member}, {size - 1}L), _n)")
    return counted.withColumn(member, F.explode(slots)).drop("_n")


def diversity(samples: DataFrame, group: Sequence[str], content: Sequence[str]) -> DataFrame:
    """Per group, whether it holds at least two different samples.

    Comparing the smallest and largest rendering needs no distinct and combines map-side.
    """
    text = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    return samples.groupBy(*group).agg((F.min(text) != F.max(text)).alias("diverse"))


def group_sizes(samples: DataFrame, group: Sequence[str], size: int) -> DataFrame:
    """Per group, its size and ``ok``, ``under`` or ``over``."""
    n = F.col("size")
    verdict = F.when(n < size, "under").when(n > size, "over").otherwise("ok")
    return samples.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).withColumn("status", verdict)


def size_report(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status over ``group_sizes`` and the verdict; one row without ``by``."""
    return sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("status") == "under").alias("under"),
        F.count_if(F.col("status") == "over").alias("over"),
    ).withColumn(
        "verdict",
        F.when(F.col("groups") == 0, "no data").when(F.col("over") > 0, "error").otherwise("ok"),
    )


def attach_metrics(batches: DataFrame, scores: DataFrame, failures: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Add ``validation_score`` and ``format_failures`` of each batch's step.

    ``batches`` has ``step``; ``scores`` is (step, score); ``failures`` is (step, format_failures).
    Step 0 falls back to the score before training, step -1.
    """
    keys = [*run, "step"]
    before = scores.where("step = -1").select(*run, F.lit(0).cast(scores.schema["step"].dataType).alias("step"),
                                              F.col("score").alias("_before"))
    return (
        batches.join(scores.select(*keys, F.col("score").alias("_score")), keys, "left")
        .join(before, keys, "left")
        .join(failures.select(*keys, "format_failures"), keys, "left")
        .withColumn("validation_score", F.coalesce("_score", "_before"))
        .withColumn("format_failures", F.coalesce("format_failures", F.lit(0)))
        .drop("_score", "_before")
    )


def format_failures(samples: DataFrame, step: Sequence[str]) -> DataFrame:
    """Failed parses per step, one for every group slot they fill."""
    return samples.groupBy(*step).agg(F.count_if("failed").alias("format_failures"))


def prompt_completion(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """Split each conversation into all but the last message, and the last (null if there is none)."""
    m = F.col(messages)
    return conversations.withColumns(
        {"prompt": F.slice(m, F.lit(1), F.greatest(F.size(m) - 1, F.lit(0))), "completion": F.try_element_at(m, F.lit(-1))}
    ).drop(messages)


def assistant_turns(conversations: DataFrame, messages: str = "messages") -> DataFrame:
    """One row per assistant message: everything before it, and the message."""
    m = F.col(messages)
    return (
        conversations.select("*", F.posexplode(m).alias("turn", "completion"))
        .where("completion.role = 'assistant'")
        .withColumn("prompt", F.slice(m, F.lit(1), F.col("turn")))
        .drop(messages)
    )


def union_groups(per_predictor: Sequence[DataFrame]) -> DataFrame:
    """Concatenate the groups of several predictors; ``predictor_no`` keeps their order."""
    numbered = [df.withColumn("predictor_no", F.lit(i)) for i, df in enumerate(per_predictor)]
    return reduce(DataFrame.unionByName, numbered)


def nest_groups(samples: DataFrame, group: Sequence[str], size: int, content: Sequence[str]) -> DataFrame:
    """One row per group with its samples as an array in member order.

    Members count from 0, so the first row with a member of ``size`` or more shows that a
    group is too large and fails the job: no array ever exceeds ``size``.
    """
    fits = F.when(F.col("member") < size, F.col("member")).otherwise(
        F.raise_error(F.lit(f"a group has more than {size} samples")).cast("bigint")
    )
    entry = F.struct(fits.alias("member"), *content)
    return samples.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("samples"))
