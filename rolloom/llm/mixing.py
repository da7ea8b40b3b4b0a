"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.session import materialize

#: Rows of the per-source table up to which it is broadcast (about 100 bytes each); above, it is shuffled.
BROADCAST_SOURCES = 20_000


def source_targets(
    docs: DataFrame, source: str, size: Column, weights: Sequence[float] = (5, 2, 1), most: float = 3
) -> DataFrame:
    """One row per source: ``source``, ``source_size`` (long) and ``target`` (double).

    Sources in code-point order, null last, take the weights in turn. Their targets share the sum
    of all sizes by weight, but none exceeds ``most`` times its source's size; what is cut off is
    shared again by weight among the rest. That fixed point is min(most * size, weight * level):
    sorted by most * size / weight, the sources at the start are the ones that are cut, and the
    first whose level lies below its own ratio sets the level for all that follow.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    count = len(weights)
    # both windows run over one row per source
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(count)) + 1)
    ).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = weighed.withColumn("level", level).withColumn(
        "cut", F.col("cap") < F.col("weight") * F.col("level")
    )
    numbered = levelled.withColumn("at", F.row_number().over(order))
    first = F.min(F.when(~F.col("cut"), F.struct("at", "level"))).over(whole)
    return numbered.select(
        "source",
        "source_size",
        F.when(F.col("cut"), F.col("cap")).otherwise(F.col("weight") * first["level"]).alias("target"),
    )


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key only: 32 bits of an MD5."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


def mix_plan(
    docs: DataFrame,
    source: str,
    size: Column,
    key: Column,
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies``.

    rate = target / source_size; a row is taken floor(rate) times and once more with probability
    equal to the fraction, decided by ``draw(seed, key)``, so reruns agree. Rows of equal key are
    drawn alike. The key should tell rows apart where ids are null. A source whose sizes sum to 0
    has target 0, rate 0 and no copies. A null source is a source of its own. Empty table: empty
    result. Input columns of these names are replaced.

    Sizes are summed per source before the shuffle; the table of sources is broadcast while it has
    at most BROADCAST_SOURCES rows, else joined by shuffle, where a hot source is split at run time.
    """
    made = ["size", "source_size", "target", "rate", "copies"]
    kept = [c for c in docs.columns if c not in made]
    inner = docs.select(
        *kept,
        F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        key.alias("_mix_key"),
        F.col(source).alias("_mix_source"),
    )
    targets = source_targets(inner, "_mix_source", F.col("size"), weights, most)
    targets = materialize(targets.withColumnRenamed("source", "_mix_of"), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    copies = (whole + (draw(seed, F.col("_mix_key")) < F.col("rate") - whole).cast("long")).cast("long")
    return (
        inner.join(targets, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
        .withColumn("rate", rate)
        .withColumn("copies", copies)
        .select(*kept, *made)
    )


def emit(plan: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mix_plan`` as often as ``copies`` says, with ``copy_no`` from 0."""
    rows = plan.where(F.col("copies") > 0)
    return rows.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
