"""Job logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.functions.variant import strip

# The fields every log line has.
LOG_FIELDS = ("timestamp", "level", "job_id", "job_type", "message", "source")


def log_lines(df: DataFrame, extra: str = "extra") -> DataFrame:
    """``value``: the JSON text of each log row. ``extra`` (VARIANT object or null) adds
    its keys and overrides the fixed fields where they clash."""
    fields = F.create_map(*[part for f in LOG_FIELDS for part in (F.lit(f), F.col(f).cast("string").cast("variant"))])
    added = F.coalesce(F.try_variant_get(F.col(extra), "$", "map<string,variant>"), F.expr("CAST(map() AS map<string,variant>)"))
    kept = F.map_filter(fields, lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return df.select(F.to_json(F.map_concat(kept, added)).alias("value"))


def write_job_logs(df: DataFrame, path: str, extra: str = "extra") -> None:
    """Append log rows to the folder ``path``."""
    log_lines(df, extra).write.mode("append").text(path)


def parse_job_logs(lines: DataFrame) -> DataFrame:
    """Text lines (``value``) to the six fields plus ``extra``, a VARIANT of all other keys.

    Works on stored and on streaming lines; lines that are not JSON objects are dropped.
    """
    parsed = lines.select(F.try_parse_json(strip(F.col("value"))).alias("_v"))
    entries = F.try_variant_get("_v", "$", "map<string,variant>")
    others = F.map_filter(F.col("_m"), lambda k, _: ~k.isin(*LOG_FIELDS))
    return (
        parsed.withColumn("_m", entries)
        .where("_m IS NOT NULL")
        .select(
            *[F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in LOG_FIELDS],
            F.when(F.size(others) > 0, F.parse_json(F.to_json(others))).alias("extra"),
        )
    )


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_job_logs(spark.read.text(path))
