"""Step requests: reading them into rollout samples, and writing samples as requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.variant import field, is_array
from rolloom.operators.grouping import nest_groups
from rolloom.operators.validation import MESSAGES

_MESSAGE = "struct<role:string,content:string>"


def request_samples(df: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """One row per sample of a step request (VARIANT): ``keys, group_no, member, sample``.

    ``batch`` may be a flat group or a list of groups, told apart by its first
    element; a flat group becomes group 0.
    """
    batch = field(F.col(request), "$.batch")
    flat = F.try_variant_get(batch, "$", "array<variant>")
    nested = F.try_variant_get(batch, "$", "array<array<variant>>")
    groups = F.when(is_array(F.get(flat, 0)), nested).otherwise(F.array(flat))
    return df.select(*keys, F.posexplode(groups).alias("group_no", "_group")).select(
        *keys, "group_no", F.posexplode("_group").alias("member", "sample")
    )


def completion_messages(sample: Column) -> Column:
    """The completion of a sample as a list of messages."""
    completion = field(sample, "$.completion")
    single = F.array(F.try_variant_get(completion, "$", _MESSAGE))
    return F.when(is_array(completion), F.try_variant_get(completion, "$", MESSAGES)).otherwise(single)


def read_rollout_groups(df: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """``keys, group_no, member, messages, completion, reward`` of every sample."""
    sample = F.col("sample")
    return request_samples(df, keys, request).select(
        *keys,
        "group_no",
        "member",
        F.try_variant_get(sample, "$.messages", MESSAGES).alias("messages"),
        completion_messages(sample).alias("completion"),
        F.try_variant_get(sample, "$.reward", "double").alias("reward"),
    )


def request_metrics(df: DataFrame, keys: Sequence[str], request: str = "request") -> DataFrame:
    """The metrics map of each request that has one."""
    metrics = F.try_variant_get(F.col(request), "$.metrics", "map<string,double>")
    return df.select(*keys, metrics.alias("metrics")).where("metrics IS NOT NULL")


def step_requests(
    samples: DataFrame, group: Sequence[str], size: int, metrics: DataFrame | None = None
) -> DataFrame:
    """``group`` and ``request``, the JSON text that ``request_samples`` reads: one request per group.

    ``samples`` has ``member`` (from 0), ``messages``, ``completion`` (lists of messages) and ``reward``; a null
    reward is left out. A group of more than ``size`` samples fails. ``metrics`` is (``group``, ``metrics``), a
    map of numbers for the groups that have some.
    """
    nested = nest_groups(samples, group, size, ["messages", "completion", "reward"])
    batch = F.transform(
        "samples",
        lambda s: F.struct(s["messages"].alias("messages"), s["completion"].alias("completion"), s["reward"].alias("reward")),
    )
    entries = [batch.alias("batch")]
    if metrics is not None:
        nested = nested.join(metrics.select(*group, "metrics"), list(group), "left")
        entries.append(F.col("metrics"))
    return nested.select(*group, F.to_json(F.struct(*entries)).alias("request"))
