"""Following job logs as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rolloom.sources.logs import parse_job_logs


def tail_logs(spark: SparkSession, path: str, source: str = "training_log") -> DataFrame:
    """New log rows of one source. The query's checkpoint remembers what was seen."""
    return parse_job_logs(spark.readStream.text(path)).where(f"source = '{source}'")
