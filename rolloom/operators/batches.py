"""From groups of chat samples to padded, penalised training batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.functions.chat import ChatTemplate
from rolloom.operators import tokens as tk
from rolloom.operators.rewards import soft_penalty


def processed_batches(
    samples: DataFrame,
    group: Sequence[str],
    size: int,
    template: ChatTemplate,
    encode: Callable[[list[str]], list[list[int]]],
    pad_id: int,
    soft: int,
    maximum: int,
    max_prompt: int | None = None,
    max_completion: int | None = None,
) -> DataFrame:
    """Check, render, tokenize, pad, flag and penalise groups of samples.

    ``samples`` has the columns of ``group``, ``prompt`` and ``completion`` (lists of messages) and
    ``reward``. Adds ids and masks of both sides, padded to the group's longest (prompts on the
    left, completions on the right), ``completion_length`` in tokens, the length flags and
    ``size_status`` (ok, under or over ``size``); ``reward`` is penalised by the completion's own length. Groups
    hold about ``size`` rows, so one shuffle on ``group`` carries all of it.
    """
    text = tk.render_chat(samples, template, "prompt")
    ids = tk.tokenize_with(text, "prompt_text", encode, "prompt_ids")
    ids = tk.tokenize_with(ids, "completion_text", encode, "completion_ids")
    left = tk.pad_left(ids, group, "prompt_ids", pad_id, "prompt_mask", bounded=True)
    padded = tk.pad_right(left, group, "completion_ids", pad_id, "completion_mask", bounded=True)
    flagged = tk.length_flags(padded, max_prompt, None, max_completion)
    count = F.count(F.lit(1)).over(Window.partitionBy(*group))
    return flagged.withColumns(
        {
            "reward": soft_penalty(F.col("reward"), F.col("completion_length"), soft, maximum),
            "size_status": F.when(count < size, "under").when(count > size, "over").otherwise("ok"),
        }
    ).drop("prompt_text", "completion_text")
