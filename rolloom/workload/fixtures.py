"""Inputs of the operators, derived from the driver tables.

Each fixture has a Spark form (a function) and a SQL form (an entry of ``SQL``, a list of
CTEs) with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators.grouping import ROLLOUT, invocations
from rolloom.plans.ordered import grouped_rank, has_crowded_key, step_chunk, time_chunk

GROUP_SIZE = 8
GROUP = ["user_id", "group_no"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events numbered from 1 within their user."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", *columns)
    return grouped_rank(events, ["user_id"], ["ts", "event_id"], time_chunk("ts", "day"), "rn")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive events of a user form a rollout group; the last one may be shorter."""
    format_reward = F.when(F.col("k") % 3 == 0, 0.0).when(F.col("k") % 3 == 2, -0.5)
    numbered = user_events(spark, sf_dir, "event_type", "value").select(
        "user_id",
        F.expr(f"(rn - 1) DIV {GROUP_SIZE}").alias("group_no"),
        ((F.col("rn") - 1) % GROUP_SIZE).alias("k"),
        "event_id",
        "event_type",
        "value",
    )
    return numbered.withColumns(
        {
            "reward": F.col("value") - 50,
            "length": F.col("k"),
            "failed": F.col("event_type") == "error",
            "format_reward": format_reward,
        }
    )


LINE_ORDER = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_linestatus",
]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trace entries: four orders are the rollouts of an example, two per teacher."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("predictor"),
        F.expr("l_orderkey DIV 4").alias("example_id"),
        F.expr("l_orderkey % 4 DIV 2").alias("teacher_id"),
        F.expr("l_orderkey % 2").alias("rollout_idx"),
        *LINE_ORDER,
    )


def trace_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rollouts, also those whose trace is empty."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey DIV 4").alias("example_id"),
        F.expr("o_orderkey % 4 DIV 2").alias("teacher_id"),
        F.expr("o_orderkey % 2").alias("rollout_idx"),
    )


def trace_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces are numbered whole, unless one is too long for a task."""
    entries = traces(spark, sf_dir)
    long = has_crowded_key(entries, ROLLOUT)
    chunk = F.struct("l_shipdate", F.expr("l_partkey DIV 1024").alias("part")) if long else None
    numbered = invocations(entries, LINE_ORDER, chunk)
    return numbered.select(
        "predictor", "example_id", "teacher_id", "rollout_idx", "inv_idx", "l_partkey", F.col("l_discount").alias("score")
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation with its messages in turn order: a training record."""
    turns = table(spark, sf_dir, "conversations")
    entry = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("_turns")).select(
        "conv_id",
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"),
    )


SFT_FILE_LINES = 16

# Planted defects by conv_id mod 11; the other residues hold valid lines.
SFT_DEFECTS = {
    0: '{"messages": [',
    1: "[1, 2]",
    2: '{"prompt": "x"}',
    3: '{"messages": "text"}',
    4: '{"messages": [{"role": "user", "content": 5}]}',
    5: "   ",
    6: '{"messages": ["hi"]}',
    7: '{"messages": [{"role": "user"}]}',
}


def _planted(residue: F.Column, defects: dict[int, str], valid: F.Column) -> F.Column:
    result = valid
    for value, text in defects.items():
        result = F.when(residue == value, F.lit(text)).otherwise(result)
    return result


def sft_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, raw``: sixteen conversations per file, with defects planted."""
    record = F.to_json(F.struct("messages"))
    return chats(spark, sf_dir).select(
        F.concat(F.lit("chat-"), F.expr(f"conv_id DIV {SFT_FILE_LINES}")).alias("file"),
        (F.col("conv_id") % SFT_FILE_LINES + 1).alias("line_no"),
        "conv_id",
        _planted(F.col("conv_id") % 11, SFT_DEFECTS, record).alias("raw"),
    )


_M = '[{"role": "user", "content": "q"}]'
_A = '[{"role": "assistant", "content": "a"}]'

# Planted defects by doc_id mod 11 of the preferred document.
DPO_DEFECTS = {
    1: f'{{"preferred_output": {_A}, "non_preferred_output": {_A}}}',
    2: f'{{"input": {{"tools": [], "parallel_tool_calls": true}}, "preferred_output": {_A}, "non_preferred_output": {_A}}}',
    3: f'{{"input": {{"messages": {_M}, "tools": {{}}, "parallel_tool_calls": true}}, "preferred_output": {_A}, "non_preferred_output": {_A}}}',
    4: f'{{"input": {{"messages": {_M}, "tools": [], "parallel_tool_calls": "yes"}}, "preferred_output": {_A}, "non_preferred_output": {_A}}}',
    5: f'{{"input": {{"messages": {_M}, "tools": [], "parallel_tool_calls": true}}, "preferred_output": null, "non_preferred_output": {_A}}}',
    6: f'{{"input": {{"messages": {_M}, "tools": [], "parallel_tool_calls": true}}, "preferred_output": {_A}, "non_preferred_output": [{{"role": 1, "content": "a"}}]}}',
    7: f'{{"input": {{"messages": {_M}, ',
}


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents of a language against bad ones, in id order; the fewer ones come again and again.

    Pair i holds the documents at place i of either side, counted round, so all of a language's labelled
    documents occur if it has both kinds.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    marked = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    placed = grouped_rank(marked, ["lang", "quality"], ["doc_id"], step_chunk("doc_id"), "pair_no")
    sizes = marked.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("n1"), F.count_if(F.col("quality") == 0).alias("n0"))
    longer = F.greatest("n1", "n0")

    def side(quality: int, id_name: str, text_name: str) -> DataFrame:
        own = F.col(f"n{quality}")
        chosen = placed.where(F.col("quality") == quality).join(sizes.where("n1 > 0 AND n0 > 0"), "lang")
        return chosen.select(
            "lang",
            F.explode(F.sequence(F.col("pair_no").cast("long"), longer, own)).alias("pair_no"),
            F.col("doc_id").alias(id_name),
            F.col("text").alias(text_name),
        )

    return side(1, "good_id", "good").join(side(0, "bad_id", "bad"), ["lang", "pair_no"])


def dpo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_no, raw``: one preference file per language, with defects planted."""

    def one(role: str, content: F.Column) -> F.Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    record = F.to_json(
        F.struct(
            F.struct(
                one("user", F.concat(F.lit("document "), F.col("good_id"))).alias("messages"),
                F.array().cast("array<string>").alias("tools"),
                F.lit(True).alias("parallel_tool_calls"),
            ).alias("input"),
            one("assistant", F.col("good")).alias("preferred_output"),
            one("assistant", F.col("bad")).alias("non_preferred_output"),
        )
    )
    return preference_pairs(spark, sf_dir).select(
        F.concat(F.lit("pairs-"), "lang").alias("file"),
        F.col("pair_no").alias("line_no"),
        "good_id",
        "bad_id",
        _planted(F.col("good_id") % 11, DPO_DEFECTS, record).alias("raw"),
    )


def token_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as tokens; an order's advantage is its price against its customer's mean."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("_mean"))
    advantage = orders.join(means, "o_custkey").select(
        F.col("o_orderkey").alias("seq_id"), ((F.col("o_totalprice") - F.col("_mean")) / 99991).alias("advantage")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("rank"),
        F.col("l_orderkey").alias("seq_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("part"),
        (-10 * F.col("l_tax")).alias("logp_new"),
        F.when(F.col("l_linenumber") != 7, -10 * F.col("l_discount")).alias("logp_old"),
        (-F.col("l_quantity") / 50).alias("logp_ref"),
        (F.col("l_linestatus") == "O").cast("int").alias("mask"),
    )
    return lines.join(advantage, "seq_id")


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, submits and gets of twelve batches per job."""
    kind = (
        F.when(F.col("event_type").isin("click", "view"), "request")
        .when(F.col("event_type") == "purchase", "submit")
        .when(F.col("event_type") == "signup", "get")
    )
    return (
        table(spark, sf_dir, "events")
        .select(
            (F.col("user_id") % 10).alias("job_id"),
            (F.col("event_id") % 12).alias("batch_id"),
            kind.alias("kind"),
            "ts",
            "event_id",
            F.col("value").alias("generation_time"),
        )
        .where("kind IS NOT NULL")
    )


# Planted by event_id mod 13; the other residues keep the event's own line.
NOISE_LINES = {
    0: "10%|█ | 3/30 [00:01, 2.5it/s]",
    1: "Adding requests: 5",
    2: "Processed prompts: 7",
    3: '  INFO: 127.0.0.1 - "POST /v1 HTTP/1.1" 200',
    4: "est. speed input: 5 toks",
    5: "est. speed output: 5 toks",
    6: "50% ░░",
    7: 'INFO: started "server"',
}

JOB_STATUS = {
    "click": "queued",
    "view": "running",
    "purchase": "succeeded",
    "error": "failed",
    "signup": "resuming",
}


def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines of a job per user."""
    from rolloom.functions.names import lookup

    events = table(spark, sf_dir, "events")
    line = F.concat("event_type", F.lit(" happened | "), "props")
    return events.select(
        F.col("user_id").alias("job_id"),
        "ts",
        "event_id",
        _planted(F.col("event_id") % 13, NOISE_LINES, line).alias("message"),
        lookup(F.col("event_type"), JOB_STATUS).alias("status"),
        F.when(F.col("event_type") == "error", "WARNING").otherwise("INFO").alias("level"),
        F.when(F.col("event_type") == "view", "uvicorn.access")
        .when(F.col("event_type") == "click", "service.manager.long_name")
        .otherwise("__main__")
        .alias("logger"),
        F.when(F.col("event_id") % 2 == 0, "training_log").otherwise("direct_log").alias("source"),
        "props",
    )


def validation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir, "value").select(
        F.col("user_id").alias("run_id"), (F.col("rn") - 2).alias("step"), F.col("value").alias("score")
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"),
        F.col("o_orderpriority").alias("checkpoint_name"),
        F.col("o_orderkey").alias("global_step"),
        F.when(F.col("o_orderkey") % 10 != 0, F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)")).cast("double").alias("timestamp"),
        F.create_map(
            F.lit("score"), F.col("o_totalprice").cast("string"), F.lit("step_index"), (F.col("o_orderkey") % 97).cast("string")
        ).alias("metadata"),
    )


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_events(spark, sf_dir, "event_type", "value").select(
        F.col("user_id").alias("run_id"), (F.col("rn") - 1).alias("step"), F.col("event_type").alias("name"), "value"
    )


LABEL_NAMES = {
    0: "card_arrival", 1: "card_linking", 2: "exchange_rate", 3: "cash_withdrawal", 4: "lost_card",
    5: "pin_blocked", 6: "top_up_failed", 7: "transfer_fee", 8: "refund", 9: "verify_identity",
}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


_LINE_SQL = ", ".join(LINE_ORDER)


def _case(residue: str, defects: dict[int, str], valid: str) -> str:
    branches = " ".join(f"WHEN {v} THEN '{t}'" for v, t in defects.items())
    return f"CASE {residue} {branches} ELSE {valid} END"


SQL = {
    "user_events": "user_events AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)",
    "rollouts": """
        numbered AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS r, event_id, event_type, value FROM events),
        rollouts AS (
            SELECT user_id, r // 8 AS group_no, r % 8 AS k, event_id, event_type, value, value - 50 AS reward,
                   r % 8 AS length, event_type = 'error' AS failed,
                   CASE r % 8 % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 2 THEN -0.5::DOUBLE END AS format_reward
            FROM numbered)""",
    "inv": f"""
        inv AS (
            SELECT l_returnflag AS predictor, l_orderkey // 4 AS example_id, l_orderkey % 4 // 2 AS teacher_id,
                   l_orderkey % 2 AS rollout_idx, l_partkey, l_discount AS score,
                   row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY {_LINE_SQL}) AS inv_idx
            FROM lineitem),
        all_rollouts AS (
            SELECT o_orderkey // 4 AS example_id, o_orderkey % 4 // 2 AS teacher_id, o_orderkey % 2 AS rollout_idx
            FROM orders)""",
    # (predictor, example) pairs where no rollout lacks the predictor
    "kept": """
        pairs AS (SELECT DISTINCT predictor, example_id FROM inv),
        kept AS (
            SELECT inv.* FROM inv WHERE NOT EXISTS (
                SELECT 1 FROM all_rollouts r WHERE r.example_id = inv.example_id AND NOT EXISTS (
                    SELECT 1 FROM inv i WHERE i.predictor = inv.predictor AND i.example_id = r.example_id
                      AND i.teacher_id = r.teacher_id AND i.rollout_idx = r.rollout_idx)))""",
    "sft_lines": f"""
        chat_json AS (
            SELECT conv_id, '{{"messages":' || to_json(list({{'role': role, 'content': text}} ORDER BY turn)) || '}}' AS record
            FROM conversations GROUP BY conv_id),
        sft_all AS (
            SELECT 'chat-' || (conv_id // {SFT_FILE_LINES}) AS file, conv_id % {SFT_FILE_LINES} + 1 AS line_no, conv_id,
                   {_case("conv_id % 11", SFT_DEFECTS, "record")} AS raw FROM chat_json),
        sft_lines AS (
            SELECT file, line_no, conv_id, raw, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS j
            FROM sft_all WHERE trim(raw) <> '')""",
    "dpo_lines": f"""
        placed AS (
            SELECT lang, quality, d.doc_id, text, row_number() OVER (PARTITION BY lang, quality ORDER BY d.doc_id) AS pair_no
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
        sides AS (SELECT lang, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0 FROM placed GROUP BY 1),
        pairs_dpo AS (
            SELECT s.lang, i.pair_no, g.doc_id AS good_id, g.text AS good, b.doc_id AS bad_id, b.text AS bad
            FROM sides s, unnest(generate_series(1, greatest(n1, n0))) i(pair_no)
            JOIN placed g ON g.lang = s.lang AND g.quality = 1 AND g.pair_no = (i.pair_no - 1) % nullif(n1, 0) + 1
            JOIN placed b ON b.lang = s.lang AND b.quality = 0 AND b.pair_no = (i.pair_no - 1) % nullif(n0, 0) + 1),
        dpo_all AS (
            SELECT 'pairs-' || lang AS file, pair_no AS line_no, good_id, bad_id,
                   {_case("good_id % 11", DPO_DEFECTS, '''to_json({'input': {'messages': [{'role': 'user', 'content': 'document ' || good_id}],
                     'tools': []::VARCHAR[], 'parallel_tool_calls': true},
                     'preferred_output': [{'role': 'assistant', 'content': good}],
                     'non_preferred_output': [{'role': 'assistant', 'content': bad}]})::VARCHAR''')} AS raw
            FROM pairs_dpo),
        dpo_lines AS (SELECT *, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw ELSE 'null' END AS j FROM dpo_all)""",
    "token_logps": """
        adv AS (
            SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey)) / 99991 AS advantage FROM orders),
        toks AS (
            SELECT l_suppkey % 4 AS rank, l_orderkey AS seq_id, l_linenumber AS pos, l_partkey AS part, advantage,
                   -10 * l_tax AS logp_new, CASE WHEN l_linenumber <> 7 THEN -10 * l_discount END AS logp_old,
                   -l_quantity / 50 AS logp_ref, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS mask
            FROM lineitem JOIN adv ON o_orderkey = l_orderkey)""",
    "batch_events": """
        be AS (
            SELECT user_id % 10 AS job_id, event_id % 12 AS batch_id, ts, event_id, value AS generation_time,
                   CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'request'
                        WHEN 'purchase' THEN 'submit' WHEN 'signup' THEN 'get' END AS kind
            FROM events WHERE event_type <> 'error')""",
    "job_logs": f"""
        logs AS (
            SELECT user_id AS job_id, ts, event_id, props,
                   {_case("event_id % 13", NOISE_LINES, "event_type || ' happened | ' || props")} AS message,
                   CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded'
                        WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'resuming' END AS status,
                   CASE WHEN event_type = 'error' THEN 'WARNING' ELSE 'INFO' END AS level,
                   CASE event_type WHEN 'view' THEN 'uvicorn.access' WHEN 'click' THEN 'service.manager.long_name'
                        ELSE '__main__' END AS logger,
                   CASE WHEN event_id % 2 = 0 THEN 'training_log' ELSE 'direct_log' END AS source
            FROM events)""",
    "scores": """
        scores AS (
            SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS step, value AS score
            FROM events)""",
}


def with_sql(*names: str) -> str:
    """A WITH clause holding the named fixtures."""
    return "WITH " + ",".join(SQL[n] for n in names) + " "
