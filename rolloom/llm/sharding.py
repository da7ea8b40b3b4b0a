"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.session import materialize

_SIZE, _TIE, _PART, _BEFORE, _ROW = "_sh_size", "_sh_tie", "_sh_part", "_sh_before", "_sh_row"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and rows that stand before each row in its partition."""
    size, row = 0, 0
    for batch in batches:
        sizes = batch.column(batch.schema.names.index(_SIZE)).to_numpy(zero_copy_only=False)
        ends = size + np.cumsum(sizes)
        rows = np.arange(row, row + len(sizes))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends - sizes, pa.int64()), pa.array(rows, pa.int64())],
            names=[*batch.schema.names, _BEFORE, _ROW],
        )
        if len(sizes):
            size, row = int(ends[-1]), row + len(sizes)


def prefix_sums(df: DataFrame, size: Column, order: list[Column], partitions: int | None = None) -> DataFrame:
    """``df`` with the bytes and rows before each row in the global order, and the grand total.

    Rows are range-partitioned by ``order``, summed within each partition in one pass, and stored;
    the totals of the partitions (one row each) then give every partition its start. Rows that are
    equal in ``order`` may stand in any order among themselves; a tie-breaker lets a run of them
    spread over partitions.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumns(
        {
            _SIZE: F.coalesce(size, F.lit(0)).cast("long"),
            _TIE: F.pmod(F.monotonically_increasing_id(), F.lit(4096)),
        }
    )
    ranged = (
        keyed.repartitionByRange(count, *order, F.col(_TIE))
        .sortWithinPartitions(*order, F.col(_TIE))
        .withColumn(_PART, F.spark_partition_id())
    )
    schema = T.StructType(list(ranged.schema.fields)).add(_BEFORE, "long").add(_ROW, "long")
    summed = ranged.mapInArrow(_running, schema)
    stored = materialize(summed, "shards")
    totals = stored.groupBy(_PART).agg(F.sum(_SIZE).alias("bytes"), F.count("*").alias("rows"))
    # one row for each partition, so this window is small whatever the data
    before = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        _PART,
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_sh_bytes0"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_sh_rows0"),
        F.sum("bytes").over(Window.partitionBy()).alias("_sh_total"),
    )
    return (
        stored.join(F.broadcast(starts), _PART)
        .withColumns({_BEFORE: F.col(_BEFORE) + F.col("_sh_bytes0"), _ROW: F.col(_ROW) + F.col("_sh_rows0")})
        .drop(_TIE, _PART, "_sh_bytes0", "_sh_rows0")
    )


def assign_shards(
    docs: DataFrame, size: Column, order: list[Column], shards: int = 16, partitions: int | None = None
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1, int) and ``slot`` (long, from 0 in each shard).

    The global order is cut at equal byte targets: a row goes to the shard that holds the middle
    of its bytes, so each shard is a contiguous run and its size is off its target by at most half
    of the row at either end. A null ``size`` counts as 0. Null order keys come first. Repeated
    rows each get a slot of their own. A row larger than a target may leave a shard empty. An empty
    table gives an empty result. Input columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    summed = prefix_sums(docs.drop("shard", "slot"), size, order, partitions)
    middle = (F.col(_BEFORE) * 2.0 + F.col(_SIZE)) / (F.col("_sh_total") * 2.0)
    cut = F.when(F.col("_sh_total") > 0, F.floor(middle * shards)).otherwise(0)
    placed = summed.withColumn("shard", F.least(cut, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min(_ROW).alias("_sh_first"))
    # at most ``shards`` rows
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col(_ROW) - F.col("_sh_first"))
        .select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """Store the result of ``assign_shards`` as one folder per shard, rows in slot order."""
    (
        assigned.repartition("shard", F.floor(F.col("slot") / 1_000_000))
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
