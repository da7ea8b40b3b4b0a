"""Queries over job logs, names, statuses and batch lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.functions import names as nm
from rolloom.operators import lifecycle as lc
from rolloom.workload import fixtures as fx
from rolloom.workload.fixtures import with_sql

QUERIES, ORACLES = {}, {}
PROVIDER = "acme:"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "parsed_log_messages",
    with_sql("job_logs")
    + """SELECT event_id, CASE WHEN ends_with(message, '}') THEN split_part(message, ' | ', 1) ELSE message END AS message,
           CASE WHEN ends_with(message, '}') THEN json_extract(split_part(message, ' | ', 2), '$.k')::BIGINT END AS k FROM logs""",
)
def parsed_log_messages(spark, d):
    parsed = lc.parse_log(fx.job_logs(spark, d))
    return parsed.select(
        "event_id", "message", F.try_variant_get("context", "$.k", "bigint").alias("k")
    )


@query(
    "component_names",
    with_sql("job_logs")
    + """SELECT event_id, CASE logger WHEN 'uvicorn.access' THEN 'api-acc' WHEN '__main__' THEN 'main' ELSE left(logger, 10) END AS component,
           left(level, 4) AS level4 FROM logs""",
)
def component_names(spark, d):
    return lc.short_names(fx.job_logs(spark, d)).select("event_id", "component", "level4")


@query(
    "noise_lines",
    with_sql("job_logs") + "SELECT event_id, event_id % 13 <= 6 AS noise FROM logs",
)
def noise_lines(spark, d):
    return fx.job_logs(spark, d).select("event_id", nm.is_noise(F.col("message")).alias("noise"))


@query(
    "status_changes",
    with_sql("job_logs")
    + """SELECT * FROM (SELECT job_id, event_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS previous_status FROM logs)
         WHERE previous_status IS NULL OR status <> previous_status""",
)
def status_changes(spark, d):
    logs = fx.job_logs(spark, d).select("job_id", "ts", "event_id", "status")
    return lc.status_changes(logs).select("job_id", "event_id", "status", "previous_status")


@query(
    "mapped_status",
    with_sql("job_logs")
    + """SELECT event_id, CASE status WHEN 'queued' THEN 'pending' WHEN 'resuming' THEN NULL ELSE status END AS training_status,
           status IN ('succeeded', 'failed') AS terminal, status = 'resuming' AS unmapped FROM logs""",
)
def mapped_status(spark, d):
    return lc.map_status(fx.job_logs(spark, d)).select("event_id", "training_status", "terminal", "unmapped")


@query(
    "latest_job_event",
    with_sql("job_logs")
    + """SELECT job_id, event_id, message, status FROM logs
         QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 3 <> 0""",
)
def latest_job_event(spark, d):
    """Newest events, where those with an id divisible by three were shown before."""
    logs = fx.job_logs(spark, d).select("job_id", "ts", "event_id", "message", "status")
    return lc.latest_event(logs, logs.where("event_id % 3 = 0")).select("job_id", "event_id", "message", "status")


_MODEL = """CASE p_partkey % 5 WHEN 0 THEN 'openai/' || p_name WHEN 1 THEN 'openai/acme:Org/' || p_name WHEN 2 THEN 'local:' || p_name
    WHEN 3 THEN 'huggingface/local:' || p_name ELSE p_name END"""


@query(
    "model_names",
    f"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'Org/' || p_name ELSE p_name END AS short_name,
          CASE WHEN p_partkey % 5 = 1 THEN 'openai/acme:Org/' || p_name ELSE 'openai/acme:' || {_MODEL} END AS full_name,
          'grpo:' || lower(regexp_extract({_MODEL}, '[^/]*$')) || ':' || p_brand || ':' || strftime(DATE '2024-01-01' + p_size, '%Y%m%d') AS job_id
        FROM part""",
)
def model_names(spark, d):
    name = F.col("p_name")
    kinds = [
        F.concat(F.lit("openai/"), name),
        F.concat(F.lit("openai/acme:Org/"), name),
        F.concat(F.lit("local:"), name),
        F.concat(F.lit("huggingface/local:"), name),
        name,
    ]
    model = F.array(*kinds)[(F.col("p_partkey") % 5).cast("int")]
    parts = fx.table(spark, d, "part").withColumn("model", model)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    return parts.select(
        "p_partkey",
        nm.strip_prefixes(F.col("model"), (*nm.MODEL_PREFIXES, PROVIDER)).alias("short_name"),
        nm.ensure_prefix(F.col("model"), f"openai/{PROVIDER}").alias("full_name"),
        nm.job_id(F.col("model"), F.col("p_brand"), day).alias("job_id"),
    )


@query(
    "batch_states",
    with_sql("batch_events")
    + """, r AS (
        SELECT *, (SELECT arg_max(p.kind, p.event_id) FROM be p WHERE p.job_id = be.job_id AND p.batch_id = be.batch_id
                   AND p.kind IN ('submit', 'get') AND p.event_id < be.event_id) AS moved FROM be)
      SELECT job_id, batch_id, bool_or(kind = 'request') AS requested, bool_or(kind = 'submit') AS submitted,
             coalesce(arg_max(kind = 'request', event_id) FILTER (WHERE kind = 'submit' OR (kind = 'request' AND coalesce(moved, '') <> 'submit')), false) AS pending,
             coalesce(arg_max(kind = 'submit', event_id) FILTER (WHERE kind IN ('submit', 'get')), false) AS completed
      FROM r GROUP BY 1, 2""",
)
def batch_states(spark, d):
    """Batches without a queue limit; ids of events grow with their time."""
    return lc.batch_flags(fx.batch_events(spark, d))


LIMIT = 4
LEDGER_SQL = with_sql("batch_events") + f""", ordered AS (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM be),
      walk AS (
        SELECT job_id, 0::BIGINT AS i, []::BIGINT[] AS pending, []::BIGINT[] AS completed, 0::BIGINT AS refused FROM ordered GROUP BY 1
        UNION ALL
        SELECT o.job_id, o.i,
               CASE WHEN o.kind = 'submit' THEN list_filter(w.pending, lambda x: x <> o.batch_id)
                    WHEN o.kind = 'request' AND NOT list_contains(w.completed, o.batch_id) AND NOT list_contains(w.pending, o.batch_id)
                         AND len(w.pending) < {LIMIT} THEN list_append(w.pending, o.batch_id) ELSE w.pending END,
               CASE WHEN o.kind = 'submit' AND NOT list_contains(w.completed, o.batch_id) THEN list_append(w.completed, o.batch_id)
                    WHEN o.kind = 'get' THEN list_filter(w.completed, lambda x: x <> o.batch_id) ELSE w.completed END,
               w.refused + CASE WHEN o.kind = 'request' AND NOT list_contains(w.completed, o.batch_id) AND NOT list_contains(w.pending, o.batch_id)
                         AND len(w.pending) >= {LIMIT} THEN 1 ELSE 0 END
        FROM walk w JOIN ordered o ON o.job_id = w.job_id AND o.i = w.i + 1),
      final AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1)"""
LEDGER_SQL = LEDGER_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "batch_ledger",
    LEDGER_SQL
    + """ SELECT job_id, array_to_string(list_sort(pending), ' ') AS pending, len(pending) AS pending_count, len(completed) AS completed_count,
            refused, len(pending) + len(completed) < 3 AS should_request FROM final""",
)
def batch_ledger(spark, d):
    ledger = lc.batch_ledger(fx.batch_events(spark, d), LIMIT, 3)
    return ledger.withColumn("pending", F.array_join(F.col("pending").cast("array<string>"), " "))


@query(
    "overdue_batches",
    with_sql("batch_events")
    + """, req AS (SELECT job_id, batch_id, min(ts) AS t FROM be WHERE kind = 'request' GROUP BY 1, 2),
      answered AS (
        SELECT DISTINCT r.job_id, r.batch_id FROM req r JOIN be s ON s.job_id = r.job_id AND s.batch_id = r.batch_id AND s.kind = 'submit'
          AND s.ts >= r.t AND s.ts <= r.t + INTERVAL 2 DAY)
      SELECT job_id, batch_id, epoch_us(t)::BIGINT AS requested_us FROM req ANTI JOIN answered USING (job_id, batch_id)""",
)
def overdue_batches(spark, d):
    late = lc.overdue(fx.batch_events(spark, d), 2 * 86400)
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', requested_at)")
    return late.select("job_id", "batch_id", micros.alias("requested_us"))


@query(
    "trailing_generation_time",
    with_sql("batch_events")
    + """SELECT job_id, event_id, round(avg(generation_time) OVER (PARTITION BY job_id ORDER BY ts, event_id
           ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS avg_generation_time FROM be WHERE kind = 'submit'""",
)
def trailing_generation_time(spark, d):
    rows = lc.generation_times(fx.batch_events(spark, d))
    return rows.select("job_id", "event_id", F.round("avg_generation_time", 6).alias("avg_generation_time"))


_RECENT = """, times AS (SELECT job_id, generation_time FROM be WHERE kind = 'submit'
    QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) <= 100),
    means AS (SELECT job_id, avg(generation_time) AS m FROM times GROUP BY 1)"""


@query(
    "recent_generation_time",
    with_sql("batch_events")
    + _RECENT
    + " SELECT job_id, round(coalesce(m, 0), 6) AS avg_generation_time FROM (SELECT DISTINCT job_id FROM be) LEFT JOIN means USING (job_id)",
)
def recent_generation_time(spark, d):
    means = lc.avg_generation_time(fx.batch_events(spark, d))
    return means.withColumn("avg_generation_time", F.round("avg_generation_time", 6))
