"""Queries over training metrics, validation scores and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from rolloom.operators import metrics as mt
from rolloom.workload import fixtures as fx
from rolloom.workload.fixtures import with_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query(
    "logging_window_means",
    with_sql("user_events")
    + """SELECT user_id AS run_id, (rn - 1) // 10 AS "window", 'eval_' || event_type AS name, round(avg(value), 6) AS value
         FROM user_events GROUP BY ALL""",
)
def logging_window_means(spark, d):
    means = mt.window_means(fx.run_metrics(spark, d), ["run_id"], 10, "eval")
    return means.withColumn("value", F.round("value", 6))


@query(
    "recent_completions",
    with_sql("user_events")
    + """SELECT user_id, (rn - 1) // 40 AS "window", event_id FROM user_events
         QUALIFY row_number() OVER (PARTITION BY user_id, (rn - 1) // 40 ORDER BY rn DESC) <= 6""",
)
def recent_completions(spark, d):
    """The last six rows of every forty of a user."""
    rows = fx.user_events(spark, d).withColumn("window", F.expr("(rn - 1) DIV 40"))
    return mt.recent(rows, ["user_id", "window"], ["rn"], 6).select("user_id", "window", "event_id")


@query(
    "external_metrics",
    with_sql("user_events")
    + """SELECT user_id AS run_id, rn - 1 AS step, event_type AS name, value FROM user_events
         UNION ALL SELECT user_id, rn - 1, 'k', json_extract_string(props, '$.k')::DOUBLE FROM user_events WHERE rn % 2 = 0
         UNION ALL SELECT user_id, rn - 1, 'half', value / 2 FROM user_events WHERE rn % 2 = 0""",
)
def external_metrics(spark, d):
    events = fx.user_events(spark, d, "props", "value").select(
        F.col("user_id").alias("run_id"),
        (F.col("rn") - 1).alias("step"),
        F.when(
            F.col("rn") % 2 == 0,
            F.create_map(
                F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("half"), F.col("value") / 2
            ),
        ).alias("metrics"),
    )
    return mt.external_metrics(fx.run_metrics(spark, d), events, ["run_id", "step"])


def _long_completions(spark, d):
    rewards = F.create_map(F.lit("reward"), F.col("reward"), F.lit("length"), F.col("length").cast("double"))
    rows = fx.rollouts(spark, d).select(
        F.concat_ws("-", "user_id", "group_no").alias("step"),
        F.col("event_id").alias("sample_id"),
        "k",
        F.col("event_type").alias("prompt"),
        F.concat(F.lit("answer "), "event_id").alias("completion"),
        F.explode(rewards).alias("reward_name", "value"),
    )
    return rows.where("NOT (reward_name = 'length' AND k = 5)")


_COMPLETIONS = with_sql("rollouts") + """, t AS (
    SELECT user_id || '-' || group_no AS step, event_id AS sample_id, k, event_type AS prompt, 'answer ' || event_id AS completion,
           round(reward, 6) AS reward, CASE WHEN k <> 5 THEN length::DOUBLE END AS length FROM rollouts)"""


@query("completions_table", _COMPLETIONS + " SELECT * EXCLUDE (k) FROM t")
def completions_table(spark, d):
    table = mt.completions_table(_long_completions(spark, d), ["reward", "length"], ["k"])
    return table.withColumn("reward", F.round("reward", 6))


@query(
    "completions_table_unique_prompts",
    _COMPLETIONS + " SELECT * EXCLUDE (k) FROM t QUALIFY row_number() OVER (PARTITION BY step, prompt ORDER BY k) = 1",
)
def completions_table_unique_prompts(spark, d):
    table = mt.completions_table(_long_completions(spark, d), ["reward", "length"], ["k"], True)
    return table.withColumn("reward", F.round("reward", 6))


@query(
    "validation_schedule",
    with_sql("scores") + "SELECT run_id, step, score FROM scores WHERE step = -1 OR step = 39 OR (step + 1) % 5 = 0",
)
def validation_schedule(spark, d):
    return mt.val_steps(fx.validation_scores(spark, d), 5, 40)


_BEST = with_sql("scores") + """, b AS (
    SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM scores)
    SELECT run_id, step, score, best_before, best_before IS NULL OR score > best_before AS improved, """


@query(
    "improved_checkpoints",
    _BEST
    + """CASE WHEN step >= 0 AND (best_before IS NULL OR score > best_before)
           THEN 'model_checkpoint_step_' || (step + 1) END AS checkpoint_name FROM b""",
)
def improved_checkpoints(spark, d):
    return mt.best_steps(fx.validation_scores(spark, d), ["run_id"], "improvements")


@query(
    "single_best_checkpoint",
    _BEST
    + """CASE WHEN step >= 0 AND (best_before IS NULL OR score > best_before)
           THEN 'model_checkpoint_best' END AS checkpoint_name FROM b""",
)
def single_best_checkpoint(spark, d):
    return mt.best_steps(fx.validation_scores(spark, d), ["run_id"], "single-best")


@query(
    "checkpoint_ledger",
    """WITH c AS (
         SELECT o_custkey AS job_id, o_orderpriority AS checkpoint_name, o_orderkey AS global_step, o_totalprice AS score, (o_orderkey % 97)::INT AS step_index,
                CASE WHEN o_orderkey % 10 <> 0 THEN epoch(o_orderdate) END AS timestamp FROM orders),
       latest AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY job_id, checkpoint_name ORDER BY coalesce(timestamp, 0) DESC, global_step DESC) = 1)
       SELECT job_id, checkpoint_name, global_step, timestamp, score, step_index,
              row_number() OVER (PARTITION BY job_id ORDER BY coalesce(timestamp, 0) DESC, global_step DESC) = 1 AS is_last FROM latest""",
)
def checkpoint_ledger(spark, d):
    ledger = mt.attach_score(mt.checkpoint_ledger(fx.checkpoints(spark, d), ["job_id"]))
    return ledger.select("job_id", "checkpoint_name", "global_step", "timestamp", "score", "step_index", "is_last")
