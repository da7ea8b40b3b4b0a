"""Format detection and validation of training lines, rollouts and traces.

``lines`` are the rows of ``scan_jsonl``: ``file, line_no, raw, parsed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.variant import (
    elements,
    field,
    has_key,
    is_array,
    is_boolean,
    is_object,
    is_string,
)

DPO_KEYS = ("input", "preferred_output", "non_preferred_output")
MESSAGES = "array<struct<role:string,content:string>>"


def record_format(parsed: Column) -> Column:
    """``sft``, ``dpo`` or ``unknown``; sft wins where both would do."""
    return (
        F.when(is_array(field(parsed, "$.messages")), "sft")
        .when(has_key(parsed, *DPO_KEYS), "dpo")
        .otherwise("unknown")
    )


def with_format(lines: DataFrame) -> DataFrame:
    return lines.withColumn("format", record_format(F.col("parsed")))


def file_format(lines: DataFrame) -> DataFrame:
    """Per file, the format of its first recognisable line, else ``unknown``."""
    known = F.when(F.col("format") != "unknown", F.col("line_no"))
    return (
        with_format(lines)
        .groupBy("file")
        .agg(F.min_by("format", known).alias("format"))
        .select("file", F.coalesce("format", F.lit("unknown")).alias("format"))
    )


def format_consistency(lines: DataFrame, expected: DataFrame) -> DataFrame:
    """Check files against ``expected`` (``file, expected_format, present``).

    Consistent: the file is present and every non-blank line parses and has
    the expected format. An existing file without lines is consistent.
    """
    found = lines.select("file", "line_no", F.col("parsed").isNull().alias("broken"), record_format(F.col("parsed")).alias("format"))
    # One row per (file, format, broken): the expected format is only needed after it.
    firsts = found.groupBy("file", "format", "broken").agg(F.min("line_no").alias("line_no"))
    bad = F.col("broken") | (F.col("format") != F.col("expected_format"))
    return (
        expected.join(firsts, "file", "left")
        .groupBy("file", "expected_format", "present")
        .agg(F.min(F.when(bad, F.col("line_no"))).alias("first_mismatch"))
        .select(
            "file",
            "expected_format",
            (F.col("present") & F.col("first_mismatch").isNull()).alias("consistent"),
            "first_mismatch",
        )
    )


def _first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The text of the first check that fails; checks are given as *violations*."""
    return F.coalesce(*[F.when(violated, F.lit(text)) for text, violated in checks])


def _message_failure(messages: Column, not_object: str, missing: str, not_text: str) -> Column:
    """First failure over a list of messages: the first bad message decides."""

    def of_message(message: Column) -> Column:
        role, content = field(message, "$.role"), field(message, "$.content")
        return _first_failure(
            [
                (not_object, ~is_object(message)),
                (missing, role.isNull() | content.isNull()),
                (not_text, ~is_string(role) | ~is_string(content)),
            ]
        )

    failures = F.filter(F.transform(messages, of_message), lambda text: text.isNotNull())
    return F.get(failures, 0)


# The messages of the failures below.
def sft_failure(parsed: Column) -> Column:
    """Why a line is not a valid chat record; null if it is one."""
    messages = field(parsed, "$.messages")
    return F.coalesce(
        _first_failure(
            [
                ("Invalid JSON", parsed.isNull()),
                ("Each line must be a JSON object", ~is_object(parsed)),
                ("Missing 'messages' field", messages.isNull()),
                ("'messages' must be an array", ~is_array(messages)),
            ]
        ),
        _message_failure(
            elements(messages),
            "Each message must be an object",
            "Messages must have 'role' and 'content' fields",
            "Message 'role' and 'content' must be strings",
        ),
    )


def dpo_failure(parsed: Column) -> Column:
    """Why a line is not a valid preference record; null if it is one."""
    prompt = field(parsed, "$.input")
    messages = field(parsed, "$.input.messages")

    def side(name: str) -> list[Column]:
        value = field(parsed, f"$.{name}")
        return [
            _first_failure([(f"'{name}' must be a list", ~is_array(value))]),
            _message_failure(
                elements(value),
                f"Each '{name}' message must be an object",
                f"Each {name} message must have 'role' and 'content'",
                f"'role' and 'content' in {name} must be strings",
            ),
        ]

    return F.coalesce(
        _first_failure(
            [
                ("Invalid JSON", parsed.isNull()),
                ("Each line must be a JSON object", ~is_object(parsed)),
                ("Missing or invalid 'input' field", ~is_object(prompt)),
                ("'input.messages' must be a list", ~is_array(messages)),
            ]
        ),
        _message_failure(
            elements(messages),
            "Each 'message' must be an object",
            "Each message must have 'role' and 'content'",
            "'role' and 'content' must be strings",
        ),
        _first_failure(
            [
                ("'input.tools' must be a list", ~is_array(field(parsed, "$.input.tools"))),
                (
                    "'input.parallel_tool_calls' must be a boolean",
                    ~is_boolean(field(parsed, "$.input.parallel_tool_calls")),
                ),
            ]
        ),
        *side("preferred_output"),
        *side("non_preferred_output"),
    )


def validate_sft(lines: DataFrame) -> DataFrame:
    """All bad lines of chat files: ``file, line_no, message``."""
    return _bad_lines(lines, sft_failure(F.col("parsed")))


def validate_dpo(lines: DataFrame) -> DataFrame:
    """All bad lines of preference files: ``file, line_no, message``."""
    return _bad_lines(lines, dpo_failure(F.col("parsed")))


def _bad_lines(lines: DataFrame, failure: Column) -> DataFrame:
    return lines.select("file", "line_no", failure.alias("message")).where("message IS NOT NULL")


UNKNOWN_FORMAT = "File format could not be determined"


def validate_files(lines: DataFrame) -> DataFrame:
    """Per file: its format, the first bad line under that format's rules, and why.

    A file whose format is unknown is itself an error, with no line.
    """
    first = F.struct("line_no", "message")
    judged = lines.select(
        "file",
        "line_no",
        record_format(F.col("parsed")).alias("format"),
        sft_failure(F.col("parsed")).alias("sft"),
        dpo_failure(F.col("parsed")).alias("dpo"),
    )
    summary = judged.groupBy("file").agg(
        F.min_by("format", F.when(F.col("format") != "unknown", F.col("line_no"))).alias("format"),
        *[
            F.min(F.when(F.col(kind).isNotNull(), F.struct("line_no", F.col(kind).alias("message")))).alias(kind)
            for kind in ("sft", "dpo")
        ],
    )
    error = F.when(F.col("format") == "sft", F.col("sft")).when(F.col("format") == "dpo", F.col("dpo"))
    return summary.select(
        "file",
        F.coalesce("format", F.lit("unknown")).alias("format"),
        error["line_no"].alias("line_no"),
        F.when(F.col("format").isNull(), UNKNOWN_FORMAT).otherwise(error["message"]).alias("message"),
    ).withColumn("valid", F.col("message").isNull())


def resolve_format(catalog: DataFrame, detected: DataFrame) -> DataFrame:
    """Catalog rows with the stored format, or the detected one where none is stored."""
    found = detected.select("file", F.col("format").alias("_detected"))
    return (
        catalog.join(found, catalog["path"] == found["file"], "left")
        .withColumn("format", F.coalesce(catalog["format"], "_detected", F.lit("unknown")))
        .drop("file", "_detected")
    )


def flatten_dpo(lines: DataFrame) -> DataFrame:
    """One row per valid preference pair: prompt, chosen and rejected messages."""

    def messages(path: str) -> Column:
        return F.try_variant_get(F.col("parsed"), path, MESSAGES)

    return lines.where(dpo_failure(F.col("parsed")).isNull()).select(
        "file",
        "line_no",
        messages("$.input.messages").alias("prompt"),
        messages("$.preferred_output").alias("chosen"),
        messages("$.non_preferred_output").alias("rejected"),
    )


def validate_rollouts(samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Add ``reason``: which required keys a sample (VARIANT) lacks, null if none."""
    value = F.col(sample)
    missing = [
        F.when(~F.coalesce(has_key(value, name), F.lit(False)), F.lit(name))
        for name in ("messages", "completion", "reward")
    ]
    reason = (
        F.when(~F.coalesce(is_object(value), F.lit(False)), "not an object")
        .when(F.size(F.array_compact(F.array(*missing))) > 0,
              F.concat(F.lit("missing "), F.array_join(F.array_compact(F.array(*missing)), ",")))
    )
    return samples.withColumn("reason", reason)


def check_group_size(samples: DataFrame, group: Sequence[str], n: int) -> DataFrame:
    """Groups that do not hold exactly ``n`` samples, with their size."""
    return samples.groupBy(*group).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") != n)


def check_traces(
    rollouts: DataFrame,
    entries: DataFrame,
    examples: DataFrame,
    teachers: Sequence[int],
    predictors: DataFrame,
    n: int,
) -> DataFrame:
    """Issues in trace data: ``example_id, teacher_id, issue, amount``.

    ``rollouts`` has one row per rollout (example_id, teacher_id, rollout_idx), ``entries``
    one row per trace entry (with ``predictor``). Reported: a wrong number of
    rollouts for an example and teacher, rollouts with an empty trace, and
    entries of a predictor that is not in ``predictors``.
    """
    pair, rollout = ["example_id", "teacher_id"], ["example_id", "teacher_id", "rollout_idx"]
    wanted = examples.select("example_id").withColumn(
        "teacher_id", F.explode(F.array(*[F.lit(t) for t in teachers]))
    )
    filled = entries.groupBy(*rollout).agg(F.count(F.lit(1)).alias("_entries"))
    counted = (
        rollouts.join(filled, rollout, "left")
        .groupBy(*pair)
        .agg(
            F.count(F.lit(1)).alias("_rollouts"),
            F.count_if(F.col("_entries").isNull()).alias("_empty"),
        )
    )
    unknown = (
        entries.groupBy(*pair, "predictor")
        .agg(F.count(F.lit(1)).alias("_entries"))
        .join(predictors.select("predictor"), "predictor", "left_anti")
        .groupBy(*pair)
        .agg(F.sum("_entries").alias("amount"))
        .select(*pair, F.lit("unknown_predictor").alias("issue"), "amount")
    )
    per_pair = wanted.join(counted, pair, "left").select(
        *pair,
        F.coalesce("_rollouts", F.lit(0)).alias("_rollouts"),
        F.coalesce("_empty", F.lit(0)).alias("_empty"),
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("_rollouts") != n, F.struct(F.lit("rollout_count").alias("issue"), F.col("_rollouts").alias("amount"))),
            F.when(F.col("_empty") > 0, F.struct(F.lit("empty_trace").alias("issue"), F.col("_empty").alias("amount"))),
        )
    )
    return (
        per_pair.select(*pair, F.explode(issues).alias("i"))
        .select(*pair, "i.issue", "i.amount")
        .unionByName(unknown)
    )
