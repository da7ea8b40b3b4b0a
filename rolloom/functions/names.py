"""Model, job, component and status names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Provider prefixes, in the order in which they are removed.
MODEL_PREFIXES = ("openai/", "huggingface/", "local:")

# Provider status to training status.
TRAINING_STATUS = {
    "validating_files": "pending",
    "queued": "pending",
    "running": "running",
    "succeeded": "succeeded",
    "failed": "failed",
    "cancelled": "cancelled",
    "pending": "pending",
    "pending_pause": "pending",
    "pending_resume": "pending",
    "paused": "pending",
    "pending_cancel": "pending",
}
TERMINAL_STATUS = ("succeeded", "failed", "cancelled")

# Logger names with a shorter display name.
COMPONENT_NAMES = {
    "__main__": "main",
    "uvicorn": "api",
    "uvicorn.access": "api-acc",
    "uvicorn.error": "api-err",
    "fastapi": "api",
}


def lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    """The mapped value, null where there is none."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def strip_prefixes(model: Column, prefixes: Sequence[str] = MODEL_PREFIXES) -> Column:
    """Remove each prefix once, in the given order."""
    for prefix in prefixes:
        model = F.when(model.startswith(prefix), F.substr(model, F.lit(len(prefix) + 1))).otherwise(model)
    return model


def ensure_prefix(model: Column, prefix: str) -> Column:
    return F.when(model.startswith(prefix), model).otherwise(F.concat(F.lit(prefix), model))


def job_id(model: Column, run: Column, day: Column) -> Column:
    """``grpo:<last path part, lower case>:<run>:<yyyymmdd>``."""
    short = F.lower(F.substring_index(model, "/", -1))
    return F.concat_ws(":", F.lit("grpo"), short, run, F.date_format(day, "yyyyMMdd"))


def training_status(status: Column) -> Column:
    """The training status of a provider status; null marks an unmapped one."""
    return lookup(status, TRAINING_STATUS)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUS)


def component_name(logger: Column, mapping: Mapping[str, str] = COMPONENT_NAMES) -> Column:
    return F.left(F.coalesce(lookup(logger, mapping), logger), F.lit(10))


def level_name(level: Column) -> Column:
    return F.left(level, F.lit(4))


def is_noise(line: Column) -> Column:
    """Progress bars, request lines and speed lines."""
    # The marker texts.
    return (
        line.contains("it/s")
        | line.contains("Adding requests:")
        | line.contains("Processed prompts:")
        | (line.rlike(r"(?U)^\s*INFO:") & line.contains(' - "') & line.contains('HTTP/1.1" '))
        | line.contains("est. speed input:")
        | line.contains("est. speed output:")
        | (line.contains("%") & (line.contains("█") | line.contains("░")))
    )
