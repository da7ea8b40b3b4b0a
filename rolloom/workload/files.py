"""Queries over training files and step requests."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from rolloom.functions.variant import field
from rolloom.operators import validation as v
from rolloom.session import materialize, scratch_path
from rolloom.sources.jsonl import file_catalog, parse_lines, scan_jsonl
from rolloom.sources.logs import read_job_logs, write_job_logs
from rolloom.sources.rollouts import read_rollout_groups, request_metrics, request_samples, step_requests
from rolloom.sources.uploads import write_training_file
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


def _lines(spark, d):
    """Chat and preference lines together, parsed."""
    chat = fx.sft_lines(spark, d).select("file", "line_no", "raw")
    pairs = fx.dpo_lines(spark, d).select("file", "line_no", "raw")
    return parse_lines(chat.unionByName(pairs))


_FORMAT = """CASE WHEN json_type(j, '$.messages') = 'ARRAY' THEN 'sft'
    WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.input') AND json_exists(j, '$.preferred_output')
         AND json_exists(j, '$.non_preferred_output') THEN 'dpo' ELSE 'unknown' END AS format"""

_ALL = with_sql("sft_lines", "dpo_lines") + f""", every AS (
    SELECT file, line_no, ok, j FROM sft_lines UNION ALL SELECT file, line_no, ok, j FROM dpo_lines),
    formatted AS (SELECT *, {_FORMAT} FROM every)"""


@query("record_format", _ALL + "SELECT file, line_no, format FROM formatted")
def record_format(spark, d):
    return v.with_format(_lines(spark, d)).select("file", "line_no", "format")


_FILE_FORMAT = """SELECT file, coalesce(min_by(format, line_no) FILTER (WHERE format <> 'unknown'), 'unknown') AS format
    FROM formatted GROUP BY 1"""


@query("file_format", _ALL + _FILE_FORMAT)
def file_format(spark, d):
    return v.file_format(_lines(spark, d))


@query(
    "format_consistency",
    _ALL
    + """, expected AS (
        SELECT DISTINCT 'chat-' || (conv_id // 16) AS file, 'sft' AS expected_format, true AS present FROM conversations
        UNION ALL SELECT DISTINCT 'pairs-' || lang, 'dpo', true FROM documents
        UNION ALL SELECT DISTINCT 'lost-' || lang, 'dpo', false FROM documents),
      bad AS (
        SELECT e.file, min(line_no) AS first_mismatch FROM formatted f JOIN expected e USING (file)
        WHERE NOT ok OR format <> expected_format GROUP BY 1)
      SELECT file, expected_format, present AND first_mismatch IS NULL AS consistent, first_mismatch
      FROM expected LEFT JOIN bad USING (file)""",
)
def format_consistency(spark, d):
    chats = fx.table(spark, d, "conversations").select(
        F.concat(F.lit("chat-"), F.expr("conv_id DIV 16")).alias("file"), F.lit("sft").alias("expected_format"), F.lit(True).alias("present")
    )
    langs = fx.table(spark, d, "documents").select("lang").distinct()

    def preference(prefix, exists):
        return langs.select(
            F.concat(F.lit(prefix), "lang").alias("file"), F.lit("dpo").alias("expected_format"), F.lit(exists).alias("present")
        )

    expected = chats.distinct().unionByName(preference("pairs-", True)).unionByName(preference("lost-", False))
    return v.format_consistency(_lines(spark, d), expected)


def _sql_messages(path: str, texts: tuple[str, str, str]) -> str:
    """First failing message of a JSON array, or NULL."""
    return f"""(SELECT min_by(CASE
            WHEN json_type(m) <> 'OBJECT' THEN '{texts[0]}'
            WHEN NOT json_exists(m, '$.role') OR NOT json_exists(m, '$.content') THEN '{texts[1]}'
            ELSE '{texts[2]}' END, i) FILTER (WHERE json_type(m) <> 'OBJECT'
            OR coalesce(json_type(m, '$.role'), '') <> 'VARCHAR' OR coalesce(json_type(m, '$.content'), '') <> 'VARCHAR')
        FROM (SELECT unnest(from_json(json_extract(j, '{path}'), '["JSON"]')) AS m,
                     generate_subscripts(from_json(json_extract(j, '{path}'), '["JSON"]'), 1) AS i))"""


_SFT_SQL = f"""CASE
    WHEN NOT ok THEN 'Invalid JSON'
    WHEN json_type(j) <> 'OBJECT' THEN 'Each line must be a JSON object'
    WHEN NOT json_exists(j, '$.messages') THEN 'Missing ''messages'' field'
    WHEN json_type(j, '$.messages') <> 'ARRAY' THEN '''messages'' must be an array'
    ELSE {_sql_messages('$.messages', ("Each message must be an object", "Messages must have ''role'' and ''content'' fields", "Message ''role'' and ''content'' must be strings"))}
    END"""


def _sql_side(name: str) -> str:
    return f"""WHEN coalesce(json_type(j, '$.{name}'), '') <> 'ARRAY' THEN '''{name}'' must be a list'
    WHEN {_sql_messages(f'$.{name}', (f"Each ''{name}'' message must be an object", f"Each {name} message must have ''role'' and ''content''", f"''role'' and ''content'' in {name} must be strings"))} IS NOT NULL
    THEN {_sql_messages(f'$.{name}', (f"Each ''{name}'' message must be an object", f"Each {name} message must have ''role'' and ''content''", f"''role'' and ''content'' in {name} must be strings"))}"""


_IN = _sql_messages("$.input.messages", ("Each ''message'' must be an object", "Each message must have ''role'' and ''content''", "''role'' and ''content'' must be strings"))
_DPO_SQL = f"""CASE
    WHEN NOT ok THEN 'Invalid JSON'
    WHEN json_type(j) <> 'OBJECT' THEN 'Each line must be a JSON object'
    WHEN coalesce(json_type(j, '$.input'), '') <> 'OBJECT' THEN 'Missing or invalid ''input'' field'
    WHEN coalesce(json_type(j, '$.input.messages'), '') <> 'ARRAY' THEN '''input.messages'' must be a list'
    WHEN {_IN} IS NOT NULL THEN {_IN}
    WHEN coalesce(json_type(j, '$.input.tools'), '') <> 'ARRAY' THEN '''input.tools'' must be a list'
    WHEN coalesce(json_type(j, '$.input.parallel_tool_calls'), '') <> 'BOOLEAN' THEN '''input.parallel_tool_calls'' must be a boolean'
    {_sql_side('preferred_output')}
    {_sql_side('non_preferred_output')}
    END"""


@query(
    "sft_validation",
    with_sql("sft_lines")
    + f"SELECT * FROM (SELECT file, line_no, {_SFT_SQL} AS message FROM sft_lines) WHERE message IS NOT NULL",
)
def sft_validation(spark, d):
    return v.validate_sft(parse_lines(fx.sft_lines(spark, d)))


@query(
    "dpo_validation",
    with_sql("dpo_lines")
    + f"SELECT * FROM (SELECT file, line_no, {_DPO_SQL} AS message FROM dpo_lines) WHERE message IS NOT NULL",
)
def dpo_validation(spark, d):
    return v.validate_dpo(parse_lines(fx.dpo_lines(spark, d)))


@query(
    "file_validation",
    _ALL
    + f""", named AS ({_FILE_FORMAT}),
      judged AS (
        SELECT f.file, f.line_no, n.format, CASE n.format WHEN 'sft' THEN {_SFT_SQL} WHEN 'dpo' THEN {_DPO_SQL} END AS message
        FROM formatted f JOIN named n USING (file)),
      firsts AS (
        SELECT file, min(line_no) AS line_no, min_by(message, line_no) AS message FROM judged WHERE message IS NOT NULL GROUP BY 1)
      SELECT n.file, n.format, f.line_no,
             CASE WHEN n.format = 'unknown' THEN 'File format could not be determined' ELSE f.message END AS message,
             n.format <> 'unknown' AND f.message IS NULL AS valid
      FROM named n LEFT JOIN firsts f USING (file)""",
)
def file_validation(spark, d):
    return v.validate_files(_lines(spark, d))


@query(
    "resolved_format",
    _ALL
    + f""", named AS ({_FILE_FORMAT})
      SELECT file AS path, CASE WHEN file LIKE '%1' THEN 'stored' ELSE format END AS format FROM named""",
)
def resolved_format(spark, d):
    """Files whose name ends in 1 have a stored format; the others use the detected one."""
    detected = v.file_format(_lines(spark, d))
    catalog = detected.select(
        F.col("file").alias("path"), F.when(F.col("file").endswith("1"), "stored").alias("format")
    )
    return v.resolve_format(catalog, detected)


@query(
    "preference_pairs",
    with_sql("dpo_lines")
    + """SELECT file, line_no, 'document ' || good_id AS prompt, md5(good) AS chosen, md5(bad) AS rejected
         FROM dpo_lines JOIN pairs_dpo USING (good_id, bad_id) WHERE good_id % 11 NOT BETWEEN 1 AND 7""",
)
def preference_pairs(spark, d):
    pairs = v.flatten_dpo(parse_lines(fx.dpo_lines(spark, d)))
    return pairs.select(
        "file",
        "line_no",
        F.col("prompt")[0]["content"].alias("prompt"),
        F.md5(F.col("chosen")[0]["content"]).alias("chosen"),
        F.md5(F.col("rejected")[0]["content"]).alias("rejected"),
    )


def _write_chat_files(spark, d):
    """One JSONL file per sixteen conversations, in conversation order."""
    path = scratch_path(spark, "chat-files")
    lines = fx.sft_lines(spark, d).select("file", "conv_id", F.col("raw").alias("value"))
    (
        lines.repartition("file")
        .sortWithinPartitions("file", "conv_id")
        .select("file", "value")
        .write.partitionBy("file")
        .text(path)
    )
    return path


@query(
    "jsonl_scan",
    with_sql("sft_lines")
    + """SELECT a.file, row_number() OVER (PARTITION BY a.file ORDER BY a.conv_id) AS line_no, md5(a.raw) AS raw_md5, json_valid(a.raw) AS parses
         FROM sft_all a QUALIFY trim(a.raw) <> ''""",
)
def jsonl_scan(spark, d):
    lines = scan_jsonl(spark, _write_chat_files(spark, d), "part-*")
    name = F.regexp_extract("file", "file=([^/]+)/", 1)
    return lines.select(
        name.alias("file"), "line_no", F.md5(F.regexp_replace("raw", "\r$", "")).alias("raw_md5"), F.col("parsed").isNotNull().alias("parses")
    )


@query(
    "upload_catalog",
    """SELECT 'id=' || (conv_id // 16) AS id, CASE WHEN conv_id // 16 % 2 = 0 THEN 'evaluation' ELSE 'training' END AS purpose,
              CASE WHEN conv_id // 16 % 3 = 0 THEN 'sft' ELSE 'unknown' END AS format, (100 + conv_id // 16)::BIGINT AS created_at, true AS has_bytes
       FROM conversations WHERE conv_id // 16 % 5 <> 4 GROUP BY ALL""",
)
def upload_catalog(spark, d):
    """Upload folders with some metadata fields missing, and every fifth without metadata."""
    root = scratch_path(spark, "uploads")
    lines = fx.sft_lines(spark, d).select(F.expr("conv_id DIV 16").alias("id"), "raw")
    lines.repartition("id").write.partitionBy("id").text(root)
    meta = lines.select("id").distinct().where("id % 5 <> 4").select(
        "id",
        F.when(F.col("id") % 2 == 0, "evaluation").alias("purpose"),
        (F.col("id") + 100).alias("created_at"),
        F.when(F.col("id") % 3 == 0, "sft").alias("format"),
    )
    meta.repartition("id").write.mode("append").partitionBy("id").json(root)
    catalog = file_catalog(spark, root, "part-*.txt", "part-*.json")
    return catalog.select("id", "purpose", "format", "created_at", (F.col("bytes") > 0).alias("has_bytes"))


@query(
    "training_file_sink",
    with_sql("sft_lines")
    + """SELECT 'training' AS purpose, 7::BIGINT AS created_at, 'chats.jsonl' AS filename, 'sft' AS format,
                count(*) AS lines, bit_xor(('0x' || substr(md5(raw), 1, 15))::BIGINT) AS digest FROM sft_all WHERE trim(raw) <> ''""",
)
def training_file_sink(spark, d):
    """Write all chat lines, then the metadata row joined with what reads back."""
    uploads = scratch_path(spark, "training-file")
    metadata = write_training_file(fx.sft_lines(spark, d), uploads, "chats.jsonl", 7, "raw", ["conv_id"], "chats")
    digest = F.conv(F.substring(F.md5("raw"), 1, 15), 16, 10).cast("bigint")
    read = scan_jsonl(spark, f"{uploads}/chats").agg(F.count(F.lit(1)).alias("lines"), F.bit_xor(digest).alias("digest"))
    return metadata.select(
        "purpose", "created_at", "filename", "format", read.select("lines").scalar().alias("lines"), read.select("digest").scalar().alias("digest")
    )


@query(
    "upload_round_trip",
    with_sql("sft_lines", "dpo_lines")
    + """SELECT 'chats' AS id, 'training' AS purpose, sum(octet_length(encode(raw)) + 1)::BIGINT AS bytes, 'chats.jsonl' AS filename, 'sft' AS format,
                true AS written_now, count(*) FILTER (trim(raw) <> '') AS lines FROM sft_all
         UNION ALL SELECT 'pairs-' || lang, 'training', sum(octet_length(encode(raw)) + 1)::BIGINT, 'data-00000.jsonl', 'dpo', true, count(*)
         FROM dpo_all JOIN pairs_dpo USING (good_id, bad_id) GROUP BY lang""",
)
def upload_round_trip(spark, d):
    """Uploads written by the sink as the catalog finds them; the pairs have no name, so they show that of their first file."""
    uploads = scratch_path(spark, "uploads")
    before = F.lit(int(time.time()))
    write_training_file(fx.sft_lines(spark, d), uploads, "chats.jsonl", None, "raw", ["conv_id"], "chats")
    pairs = materialize(fx.dpo_lines(spark, d).select("file", "line_no", "raw"), "pairs")
    for (file,) in pairs.select("file").distinct().collect():  # one upload per language
        write_training_file(pairs.where(F.col("file") == file), uploads, None, None, "raw", ["line_no"], file)
    catalog = materialize(file_catalog(spark, uploads), "catalog")
    folder = F.element_at(F.split("file", "/"), -2)
    lines = scan_jsonl(spark, [r.path for r in catalog.select("path").collect()]).groupBy(folder.alias("id")).agg(F.count(F.lit(1)).alias("lines"))
    recent = (F.col("created_at") >= before) & (F.col("created_at") < before + 3600)
    return catalog.join(lines, "id").select("id", "purpose", "bytes", "filename", "format", recent.alias("written_now"), "lines")


def _requests(spark, d):
    """Rollout groups as step requests: even groups flat, odd groups as a list of two groups;
    completions alternate between one message and a list. Some samples lack a key."""

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    content = F.concat(F.lit("answer "), F.col("event_id"))
    completion = F.when(
        F.col("k") % 2 == 0, F.to_json(F.array(message("assistant", content)))
    ).otherwise(F.to_json(message("assistant", content)))
    prompt = F.to_json(F.array(message("user", F.col("event_type"))))
    reward = F.when(F.col("event_id") % 17 != 0, F.concat(F.lit(', "reward": '), F.col("value"))).otherwise("")
    sample = F.concat(F.lit('{"messages": '), prompt, F.lit(', "completion": '), completion, reward, F.lit("}"))
    text = fx.rollouts(spark, d).select(*fx.GROUP, "k", sample.alias("s"))
    # A group holds GROUP_SIZE rows by construction.
    ordered = F.array_sort(F.collect_list(F.struct("k", "s")))
    groups = text.groupBy(*fx.GROUP).agg(F.transform(ordered, lambda e: e["s"]).alias("s"))

    def listed(samples):
        return F.concat(F.lit("["), F.array_join(samples, ", "), F.lit("]"))

    batch = F.when(F.col("group_no") % 2 == 0, listed("s")).otherwise(
        F.concat(F.lit("["), listed(F.slice("s", 1, 4)), F.lit(", "), listed(F.slice("s", 5, 4)), F.lit("]"))
    )
    metrics = F.when(F.col("group_no") % 3 == 0, F.concat(F.lit(', "metrics": {"group": '), F.col("group_no"), F.lit("}"))).otherwise("")
    return groups.select(
        *fx.GROUP, F.parse_json(F.concat(F.lit('{"batch": '), batch, metrics, F.lit("}"))).alias("request")
    )


_SAMPLES = with_sql("rollouts") + """, samples AS (
    SELECT user_id, group_no AS request_no, CASE WHEN group_no % 2 = 0 THEN 0 ELSE k // 4 END AS group_no,
           CASE WHEN group_no % 2 = 0 THEN k ELSE k % 4 END AS member, event_id, event_type, value FROM rollouts)"""


@query(
    "step_request_samples",
    _SAMPLES
    + """SELECT user_id, request_no, group_no, member, event_type AS prompt, 'assistant' AS role, 'answer ' || event_id AS answer, 1 AS messages,
           CASE WHEN event_id % 17 <> 0 THEN round(value, 6) END AS reward FROM samples""",
)
def step_request_samples(spark, d):
    requests = _requests(spark, d).withColumnRenamed("group_no", "request_no")
    samples = read_rollout_groups(requests, ["user_id", "request_no"])
    return samples.select(
        "user_id", "request_no", "group_no", "member",
        F.col("messages")[0]["content"].alias("prompt"),
        F.col("completion")[0]["role"].alias("role"),
        F.col("completion")[0]["content"].alias("answer"),
        F.size("completion").alias("messages"),
        F.round("reward", 6).alias("reward"),
    )


@query(
    "rollout_sample_check",
    _SAMPLES
    + """SELECT user_id, request_no, group_no, member, CASE WHEN event_id % 17 = 0 THEN 'missing reward' END AS reason FROM samples""",
)
def rollout_sample_check(spark, d):
    requests = _requests(spark, d).withColumnRenamed("group_no", "request_no")
    return v.validate_rollouts(request_samples(requests, ["user_id", "request_no"])).drop("sample")


@query(
    "step_request_metrics",
    with_sql("rollouts")
    + """SELECT DISTINCT user_id, group_no, 'group' AS name, group_no::DOUBLE AS value FROM rollouts WHERE group_no % 3 = 0""",
)
def step_request_metrics(spark, d):
    metrics = request_metrics(_requests(spark, d), fx.GROUP)
    return metrics.select(*fx.GROUP, F.explode("metrics").alias("name", "value"))


@query(
    "step_request_round_trip",
    with_sql("rollouts")
    + """SELECT user_id, group_no AS request_no, k AS member, event_type AS prompt, 'answer ' || event_id AS answer,
           CASE WHEN NOT failed THEN round(reward, 6) END AS reward, CASE WHEN group_no % 3 = 0 THEN group_no::DOUBLE END AS metric
         FROM rollouts""",
)
def step_request_round_trip(spark, d):
    """Write every rollout group as a step request file, read the requests back."""

    def message(role, content):
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    rollouts = fx.rollouts(spark, d)
    samples = rollouts.select(
        *fx.GROUP,
        F.col("k").alias("member"),
        message("user", F.col("event_type")).alias("messages"),
        message("assistant", F.concat(F.lit("answer "), "event_id")).alias("completion"),
        F.when(~F.col("failed"), F.col("reward")).alias("reward"),
    )
    metrics = rollouts.where("group_no % 3 = 0").select(*fx.GROUP).distinct()
    metrics = metrics.withColumn("metrics", F.create_map(F.lit("group"), F.col("group_no").cast("double")))
    path = scratch_path(spark, "step-requests")
    step_requests(samples, fx.GROUP, fx.GROUP_SIZE, metrics).write.json(path)
    stored = spark.read.schema("user_id long, group_no long, request string").json(path)
    requests = stored.select("user_id", F.col("group_no").alias("request_no"), F.parse_json("request").alias("request"))
    keys = ["user_id", "request_no"]
    read = read_rollout_groups(requests, keys).join(request_metrics(requests, keys), keys, "left")
    return read.select(
        *keys,
        F.col("member").cast("bigint").alias("member"),
        F.col("messages")[0]["content"].alias("prompt"),
        F.col("completion")[0]["content"].alias("answer"),
        F.round("reward", 6).alias("reward"),
        F.col("metrics")["group"].alias("metric"),
    )


@query(
    "job_log_round_trip",
    with_sql("job_logs")
    + """SELECT event_id, job_id::VARCHAR AS job_id, CASE WHEN event_id % 5 = 0 THEN 'overridden' ELSE level END AS level, message, source,
           json_extract_string(props, '$.k')::BIGINT AS k FROM logs""",
)
def job_log_round_trip(spark, d):
    """Write log lines whose extra keys sometimes override a fixed field; read them back."""
    logs = fx.job_logs(spark, d)
    override = F.when(F.col("event_id") % 5 == 0, F.lit(', "level": "overridden"')).otherwise("")
    k = F.get_json_object("props", "$.k")
    extra = F.parse_json(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "k": '), k, override, F.lit("}")))
    path = scratch_path(spark, "job-logs")
    write_job_logs(
        logs.select(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "level", "job_id",
            F.lit("GRPO").alias("job_type"), "message", "source", extra.alias("extra"),
        ),
        path,
    )
    read = read_job_logs(spark, path)
    number = lambda name: field(F.col("extra"), f"$.{name}").cast("bigint").alias(name)
    return read.select(number("event_id"), "job_id", "level", "message", "source", number("k"))
