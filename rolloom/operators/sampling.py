"""Splits, epoch plans, rollout fan-out and batch dispatch.

Random orders are md5 orders (see ``seeded_hash``): uniform, reproducible from the seed, and
independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.plans.ordered import grouped_rank, hash_chunk, seeded_hash

# Slots of an epoch, pads included: a column of every plan.
WIDTH = "width"

# Chunks of a global rank: their counts are the only rows that meet in one task.
MAX_CHUNKS = 65536


def shuffled(df: DataFrame, key: str, seed: object, keys: Sequence[str] = (), name: str = "position") -> DataFrame:
    """Add the 0-based place of each row in a seeded shuffle, within ``keys``."""
    hashed = df.withColumn("_hash", seeded_hash(seed, *keys, key))
    ranked = grouped_rank(hashed, keys, ["_hash", key], hash_chunk(F.col("_hash")), name)
    return ranked.withColumn(name, F.col(name) - 1).drop("_hash")


def split(df: DataFrame, key: str, sizes: Sequence[tuple[str, int | None]], seed: int) -> DataFrame:
    """Shuffle, then cut into consecutive named ranges; a size of None takes the rest.

    Rows beyond the last range get a null ``split``.
    """
    label, start = F.lit(None).cast("string"), 0
    branches = []
    for name, size in sizes:
        upper = None if size is None else start + size
        branches.append((name, start, upper))
        start = upper or start
    for name, low, high in reversed(branches):
        inside = F.col("position") >= low
        if high is not None:
            inside = inside & (F.col("position") < high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return shuffled(df, key, seed).withColumn("split", label)


def repeat_to(df: DataFrame, k: int) -> DataFrame:
    """Repeat a set smaller than ``k`` until it holds at least ``k`` rows; adds ``copy``."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    copies = F.greatest(F.ceil(F.lit(k) / n), F.lit(1).cast("bigint"))
    return (
        df.withColumn("_copies", copies)
        .withColumn("copy", F.explode(F.expr("sequence(0L, _copies - 1)")))
        .drop("_copies")
    )


def epoch_plan(
    df: DataFrame, key: str, k: int, epochs: int, seed: int, pad_full_group: bool = True
) -> DataFrame:
    """``epoch, slot, key, width``: one shuffle per epoch, padded to ``width``, a multiple of ``k``.

    Each pad is the least-used id so far, ties going to the id latest in the
    first shuffle. With n ids, the t-th pad over all epochs is therefore the id
    at place n-1-(t mod n) of the first shuffle. When n already is a multiple of k a whole
    extra group is added, unless ``pad_full_group`` is off.
    """
    ids = df.select(key)
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    rest = f"_n % {k}"
    full = k if pad_full_group else 0
    per_epoch = ids.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    slots = shuffled(per_epoch, key, seed, ["epoch"], "slot").select("epoch", "slot", key)
    sized = slots.withColumn("_n", n).withColumn(
        "_pads", F.expr(f"CAST(CASE WHEN {rest} = 0 THEN {full} ELSE {k} - {rest} END AS BIGINT)")
    )
    # Besides its own place, an id of the first shuffle may fill pads of any epoch.
    own = F.array(F.struct(F.col("epoch"), F.col("slot")))
    pad = F.transform(
        F.expr(f"sequence(_n - 1 - slot, {epochs} * _pads - 1, _n)"),
        lambda t: F.struct(F.floor(t / F.col("_pads")).cast("int").alias("epoch"), (F.col("_n") + t % F.col("_pads")).alias("slot")),
    )
    padding = (F.col("epoch") == 0) & (F.expr(f"_n - 1 - slot < {epochs} * _pads"))
    placed = F.when(padding, F.concat(own, pad)).otherwise(own)
    return (
        sized.withColumn("_at", F.explode(placed))
        .select("_at.epoch", "_at.slot", key, (F.col("_n") + F.col("_pads")).alias(WIDTH))
    )


def select_steps(plan: DataFrame, k: int, steps: int | None = None) -> DataFrame:
    """Add ``step`` and ``place`` in the step to an epoch plan; keep the first ``steps`` steps, or all."""
    placed = (
        plan.withColumn("_at", F.col("epoch") * F.col(WIDTH) + F.col("slot"))
        .withColumns({"step": F.expr(f"_at DIV {k}"), "place": F.expr(f"_at % {k}")})
        .drop("_at", WIDTH)
    )
    return placed if steps is None else placed.where(F.col("step") < steps)


def fan_out(step_rows: DataFrame, teachers: int, rollouts: int, k: int) -> DataFrame:
    """One row per rollout of each step example.

    Every teacher gets ``rollouts / teachers`` samples; ``task`` numbers a teacher's work
    sample-major, so ``task mod k`` is the example's place in its step.
    """
    if rollouts % teachers:
        raise ValueError("the number of rollouts must be divisible by the number of teachers")
    samples = rollouts // teachers
    return (
        step_rows.withColumn("teacher_id", F.explode(F.sequence(F.lit(0), F.lit(teachers - 1))))
        .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
        .withColumn("task", F.col("sample") * k + F.col("place"))
        .withColumn("example_ind", F.pmod("task", F.lit(k)))
    )


def shard(
    df: DataFrame, batch: Sequence[str], idx: str, world: int, chunks: int, seed: int, bounded: bool = False
) -> DataFrame:
    """Assign rows of a batch to ranks and micro-batches.

    Rank r takes the r-th slice of ceil(total/world) consecutive rows (``idx`` is
    0-based). Within a rank a seeded permutation is cut into ``chunks`` parts of
    floor(size/chunks) rows; the rows left over belong to none and are dropped.
    ``bounded=True`` asserts that the size of the batches has been checked: then
    plain windows do, with one shuffle on the batch.
    """
    per_rank = F.ceil(F.col("_total") / world)
    rank = F.floor(F.col(idx) / per_rank)
    if bounded:
        total = F.count(F.lit(1)).over(Window.partitionBy(*batch))
        ranked = df.withColumn("_total", total).withColumn("rank", rank)
        order = Window.partitionBy(*batch, "rank").orderBy(seeded_hash(seed, *batch, "rank", idx), idx)
        placed = ranked.withColumn("_place", F.row_number().over(order) - 1)
    else:
        totals = df.groupBy(*batch).agg(F.count(F.lit(1)).alias("_total"))
        ranked = df.join(totals, list(batch)).withColumn("rank", rank)
        placed = shuffled(ranked, idx, seed, [*batch, "rank"], "_place")
    in_rank = F.least(F.col("_total") - F.col("rank") * per_rank, per_rank)
    return (
        placed.withColumn("_size", F.floor(in_rank / chunks))
        .where(F.col("_place") < F.col("_size") * chunks)
        .withColumn("micro_batch", F.floor(F.col("_place") / F.col("_size")))
        .drop("_total", "_place", "_size")
    )


def dispatch(
    groups: DataFrame, group_key: str, pending: DataFrame, fulfilled: DataFrame, batch_key: str, seed: int
) -> DataFrame:
    """Give one group to every batch id that is pending and not fulfilled.

    Ids are served in ascending order from a queue of seeded permutations of the groups,
    as many as needed: the j-th id gets place ``j mod n`` of permutation ``j div n``.
    """
    free = pending.select(batch_key).distinct().join(fulfilled.select(batch_key), batch_key, "left_anti")
    id_range = free.agg(F.count(F.lit(1)).alias("n"), F.min(batch_key).alias("low"), F.max(batch_key).alias("high"))
    low, high = id_range.select("low").scalar(), id_range.select("high").scalar()
    # Ids are unique, so equal ranges of them are chunks of bounded size and number.
    width = F.ceil((high - low + 1) / F.lit(MAX_CHUNKS))
    chunk = F.floor((F.col(batch_key) - low) / width)
    ordered = grouped_rank(free, [], [batch_key], chunk, "_j").withColumn("_j", F.col("_j") - 1)
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    needed = id_range.select("n").scalar()
    queue = (
        groups.select(group_key)
        .withColumn("_perms", F.ceil(needed / n))
        .where("_perms > 0")
        .withColumn("permutation", F.explode(F.expr("sequence(0L, _perms - 1)")))
        .drop("_perms")
    )
    placed = shuffled(queue, group_key, seed, ["permutation"], "place")
    wanted = ordered.withColumn("_n", n).select(
        batch_key, F.expr("_j DIV _n").alias("permutation"), F.expr("_j % _n").alias("place")
    )
    return wanted.join(placed, ["permutation", "place"])
