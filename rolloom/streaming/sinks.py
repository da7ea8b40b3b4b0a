"""Running streams to completion with durable, replayable output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_available(stream: DataFrame, output: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived since the last run and stop.

    Each micro-batch overwrites its own folder, so a batch replayed after a failure
    leaves no duplicates. Executors do the writing; nothing passes through the driver.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/micro_batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def _live_parts(batches: int) -> list[int]:
    """The parts that together hold the first ``batches`` micro-batches.

    Part b holds as many micro-batches, up to number b, as the greatest power of two that divides b + 1.
    """
    parts = []
    while batches:
        parts.append(batches - 1)
        batches &= batches - 1
    return parts


def merge_available(
    stream: DataFrame, table: str, checkpoint: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]
) -> None:
    """Fold what has arrived into a stored table and stop.

    ``partial`` turns a micro-batch into rows of the table, ``merge`` joins rows of several of them into fewer. A micro-batch is merged
    with parts of no more micro-batches than itself, as the ones of a binary counter are carried, so each row is written again once for every doubling of
    the micro-batches and not in each of them. At the end of a run the parts (one per binary one of the number of micro-batches)
    are merged into a new version of the whole table. A replayed micro-batch reads only parts before its own and overwrites
    what it had written, so nothing counts twice.
    """
    spark, folder = stream.sparkSession, f"{table}/parts"

    def stored(session: SparkSession, schema: T.StructType, parts: list[int]) -> DataFrame:
        return session.read.schema(schema).parquet(*[f"{folder}/part={part}" for part in parts])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = partial(batch)
        kept = set(_live_parts(batch_id + 1))
        carried = [part for part in _live_parts(batch_id) if part not in kept]
        if carried:
            rows = merge(stored(batch.sparkSession, rows.schema, carried).unionByName(rows))
        rows.write.mode("overwrite").parquet(f"{folder}/part={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    parts = spark.read.parquet(folder)
    last = parts.agg(F.max("part")).first()[0] or 0
    whole = merge(stored(spark, parts.drop("part").schema, _live_parts(last + 1)))
    whole.write.mode("overwrite").parquet(f"{table}/whole/version={last}")


def latest_version(spark: SparkSession, table: str) -> DataFrame:
    """The newest version of the whole table that ``merge_available`` has stored."""
    versions = spark.read.parquet(f"{table}/whole")
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")
