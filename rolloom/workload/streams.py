"""Streaming queries: the driver tables arrive in slices of at most ``SLICE_ROWS`` rows in the order of time.

Each slice is one file and one micro-batch, so a micro-batch is bounded whatever the table. The stream is run over what is new and
stopped, ``RUNS`` times; state and position survive in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.operators import metrics as mt
from rolloom.plans.ordered import grouped_rank, row_chunks
from rolloom.session import materialize, scratch_path
from rolloom.sources.logs import write_job_logs
from rolloom.streaming.ledger import ROCKSDB, batch_ledger_stream
from rolloom.streaming.overdue import overdue_stream
from rolloom.streaming.sinks import latest_version, run_available
from rolloom.streaming.tail import tail_logs
from rolloom.streaming.windows import recent_stream, window_means_stream
from rolloom.workload import fixtures as fx
from rolloom.workload.fixtures import with_sql
from rolloom.workload.lifecycle import LEDGER_SQL, LIMIT, _RECENT
from rolloom.workload.runs import ORACLES as RUNS_SQL

QUERIES, ORACLES = {}, {}

# Id of the events that close a stream.
CLOSING = -1

SLICE_ROWS, RUNS = 1_000_000, 3
PARTITIONS = "spark.sql.shuffle.partitions"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _in_slices(rows: DataFrame, write: Callable[[DataFrame], None], run: Callable[[], None]) -> None:
    """Rows without a time come first, as in any ascending order.

    The rows are ranked and stored by slice once; each slice is then read alone. A small table has smaller slices, one for each run.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "arriving")
    size = max(1, min(SLICE_ROWS, -(-rows.count() // RUNS)))
    chunked, at = row_chunks(rows, [], "ts")
    ranked = grouped_rank(chunked, [], ["ts", "event_id"], at, "_rank")
    folder = scratch_path(spark, "slices")
    ranked.select(*rows.columns, F.expr(f"(_rank - 1) DIV {size}").alias("_slice")).write.partitionBy("_slice").parquet(folder)
    slices = -(-rows.count() // size)
    each = max(-(-slices // RUNS), 1)
    for number in range(slices):
        write(spark.read.schema(rows.schema).parquet(f"{folder}/_slice={number}"))
        if (number + 1) % each == 0 or number + 1 == slices:
            run()


def _arrive(rows: DataFrame, source: str, run: Callable[[DataFrame], None]) -> None:
    """Write slices as files to ``source`` and call ``run`` with the stream of what is new, a file per micro-batch."""
    reader = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    _in_slices(rows, lambda part: part.coalesce(1).write.mode("append").parquet(source), lambda: run(reader.parquet(source)))


def _feed(rows: DataFrame, label: str, stream: Callable[[DataFrame], DataFrame], mode: str) -> str:
    """Run ``stream`` over the rows in slices; the folder of its output.

    A micro-batch is bounded, so its state is kept in as many partitions as there are cores and not in as many as a whole table needs.
    """
    spark = rows.sparkSession
    source, output, checkpoint = (scratch_path(spark, f"{label}-{part}") for part in ("in", "out", "checkpoint"))

    def run(new: DataFrame) -> None:
        before = spark.conf.get(PARTITIONS)
        spark.conf.set(PARTITIONS, str(spark.sparkContext.defaultParallelism))
        try:
            run_available(stream(new), output, checkpoint, mode)
        finally:
            spark.conf.set(PARTITIONS, before)

    _arrive(rows, source, run)
    return output


@query(
    "streaming_batch_ledger",
    LEDGER_SQL
    + _RECENT
    + """ SELECT job_id, max_i AS events, array_to_string(list_sort(pending), ' ') AS pending, len(completed) AS completed_count, refused,
            round(coalesce(m, 0), 6) AS avg_generation_time
          FROM final LEFT JOIN means USING (job_id) JOIN (SELECT job_id, count(*) AS max_i FROM be GROUP BY 1) USING (job_id)""",
)
def streaming_batch_ledger(spark, d):
    """The last ledger of every job after all slices."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    rows = fx.batch_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    spark.conf.set(setting, ROCKSDB)
    try:
        output = _feed(rows, "ledger", lambda events: batch_ledger_stream(events, LIMIT), "update")
    finally:
        spark.conf.set(setting, before)
    last = (
        spark.read.parquet(output)
        .groupBy("job_id")
        .agg(F.max_by(F.struct("events", "pending", "completed_count", "refused", "avg_generation_time"), "events").alias("s"))
        .select("job_id", "s.*")
    )
    return last.withColumns(
        {
            "pending": F.array_join(F.col("pending").cast("array<string>"), " "),
            "avg_generation_time": F.round("avg_generation_time", 6),
        }
    )


@query(
    "streaming_overdue_requests",
    with_sql("batch_events")
    + """SELECT job_id, batch_id, event_id FROM be r WHERE kind = 'request' AND NOT EXISTS (
           SELECT 1 FROM be s WHERE s.kind = 'submit' AND s.job_id = r.job_id AND s.batch_id = r.batch_id
             AND s.ts >= r.ts AND s.ts <= r.ts + INTERVAL 1 DAY)""",
)
def streaming_overdue_requests(spark, d):
    """Requests that were not answered within a day; a closing pair of events settles the last ones."""
    rows = fx.batch_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    end = rows.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    closing = end.select(
        F.lit(CLOSING).cast(rows.schema["job_id"].dataType).alias("job_id"),
        F.lit(CLOSING).cast(rows.schema["batch_id"].dataType).alias("batch_id"),
        F.explode(F.array(F.lit("request"), F.lit("submit"))).alias("kind"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"),
        F.lit(CLOSING).cast(rows.schema["event_id"].dataType).alias("event_id"),
        F.lit(0.0).alias("generation_time"),
    )
    rows = rows.unionByName(closing)

    def stream(events: DataFrame) -> DataFrame:
        columns = ["job_id", "batch_id", "ts", "event_id"]
        requests = events.where("kind = 'request'").select(*columns)
        submits = events.where("kind = 'submit'").select(*columns)
        return overdue_stream(requests, submits, "1 DAY", "1 hour")

    found = spark.read.parquet(_feed(rows, "overdue", stream, "append"))
    return found.where(F.col("job_id") != CLOSING).select("job_id", "batch_id", "event_id")


@query(
    "streaming_log_tail",
    with_sql("job_logs")
    + "SELECT job_id::VARCHAR AS job_id, level, message, count(*) AS lines FROM logs WHERE source = 'training_log' GROUP BY ALL",
)
def streaming_log_tail(spark, d):
    """Lines of the training source, counted after following the log through all slices."""
    path, output, checkpoint = (scratch_path(spark, f"tail-{part}") for part in ("in", "out", "checkpoint"))
    logs = fx.job_logs(spark, d).withColumns(
        {
            "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
            "job_type": F.lit("GRPO"),
            "extra": F.parse_json("props"),
        }
    )
    _in_slices(
        logs, lambda part: write_job_logs(part, path), lambda: run_available(tail_logs(spark, path), output, checkpoint)
    )
    return spark.read.parquet(output).groupBy("job_id", "level", "message").agg(F.count(F.lit(1)).alias("lines"))


@query("streaming_window_means", RUNS_SQL["logging_window_means"])
def streaming_window_means(spark, d):
    """Means of log windows that fill over all slices; the stored sums are merged after each."""
    rows = fx.user_events(spark, d, "value", "event_type").select("*", (F.col("rn") - 1).alias("step"), F.col("event_type").alias("name"))
    source, table, checkpoint = (scratch_path(spark, f"means-{part}") for part in ("in", "table", "checkpoint"))
    _arrive(rows, source, lambda new: window_means_stream(new, table, checkpoint, ["user_id"], 10, "eval"))
    means = mt.mean_of_sums(latest_version(spark, table), ["user_id"])
    return means.select(F.col("user_id").alias("run_id"), "window", "name", F.round("value", 6).alias("value"))


@query("streaming_recent_completions", RUNS_SQL["recent_completions"])
def streaming_recent_completions(spark, d):
    """The last six rows of every forty of a user, kept up as rows arrive."""
    rows = fx.user_events(spark, d).withColumn("window", F.expr("(rn - 1) DIV 40"))
    source, table, checkpoint = (scratch_path(spark, f"recent-{part}") for part in ("in", "table", "checkpoint"))
    _arrive(rows, source, lambda new: recent_stream(new, table, checkpoint, ["user_id", "window"], ["rn"], 6))
    return latest_version(spark, table).select("user_id", "window", "event_id")
