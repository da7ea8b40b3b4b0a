"""Log windows that fill as rows arrive: means of metrics and the last rows of each window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from rolloom.operators import metrics as mt
from rolloom.streaming.sinks import merge_available


def window_means_stream(
    metrics: DataFrame, table: str, checkpoint: str, run: Sequence[str], logging_steps: int, mode: str = "train"
) -> None:
    """Keep ``window_sums`` of a stream in ``table``; ``mean_of_sums`` reads the means off its latest version.

    Windows count steps and not time, so late rows need no watermark: they are added to their window whenever they come.
    """
    merge_available(
        metrics, table, checkpoint, lambda rows: mt.window_sums(rows, run, logging_steps, mode), lambda sums: mt.add_sums(sums, run)
    )


def recent_stream(rows: DataFrame, table: str, checkpoint: str, window: Sequence[str], order: Sequence[str], n: int) -> None:
    """Keep the last ``n`` rows of each window in ``table``: those of the stored ones and the new ones together."""

    def last(some: DataFrame) -> DataFrame:
        return mt.recent(some, window, order, n)

    merge_available(rows, table, checkpoint, last, last)
