"""Requests that were not answered in time, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Of a batch: the requests still open with their last moments, and the moments of submits that a late request may still meet.
_STATE = "at array<bigint>, until array<bigint>, event array<string>, submits array<bigint>"


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold new events of one batch into its state; the requests that the watermark has left unanswered. Times are microseconds."""
    at, until, event, submits = ([list(part)] for part in state.get) if state.exists else ([], [], [], [])
    # One batch's rows of one micro-batch, whose size the source's rate limit bounds; nothing comes with a timeout.
    for frame in () if state.hasTimedOut else frames:
        answer = frame["submit"].to_numpy(bool)
        submits.append(frame["at"].to_numpy(np.int64)[answer])
        at.append(frame["at"].to_numpy(np.int64)[~answer])
        until.append(frame["until"].to_numpy(np.int64)[~answer])
        event.append(frame["event"].to_numpy(object)[~answer])
    at, until, submits = (np.concatenate([np.asarray(p, np.int64) for p in [*parts, []]]) for parts in (at, until, submits))
    event = np.concatenate([*(np.asarray(part, object) for part in event), np.empty(0, object)])
    answers = np.unique(submits)
    # the first submit from the request on tells whether any is in time
    following = np.append(answers, np.iinfo(np.int64).max)[np.searchsorted(answers, at)]
    waits = following > until
    passed = state.getCurrentWatermarkMs() * 1000
    left, late = waits & (until > passed), waits & (until <= passed)
    answers = answers[answers > passed]
    if left.any() or len(answers):
        state.update((at[left].tolist(), until[left].tolist(), event[left].tolist(), answers.tolist()))
        moment = int(until[left].min() if left.any() else answers[-1])
        state.setTimeoutTimestamp(max(moment, passed) // 1000 + 1)
    elif state.exists:
        state.remove()
    if late.any():
        named = {"job_id": [key[0]] * int(late.sum()), "batch_id": [key[1]] * int(late.sum())}
        yield pd.DataFrame({**named, "at": at[late], "event": event[late]})


def overdue_stream(requests: DataFrame, submits: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Requests without a submit of the same batch within ``timeout``.

    Both streams are ``job_id, batch_id, ts, event_id`` with ``ts`` a timestamp. A request is
    reported once the watermark (``delay`` behind the newest event of the stream that is further behind) has passed its
    timeout. State holds requests until they are answered or reported, and submits until the watermark has passed them; no request
    meets more than the first submit after it, so work grows with the events and not with the pairs in ``timeout``.

    Requests without a time never time out; a job or batch that is null is not answered by another null. Bound a micro-batch
    with the source's rate limit (``maxBytesPerTrigger``, ``maxFilesPerTrigger``).
    """
    keys = ["job_id", "batch_id"]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    left = requests.withWatermark("ts", delay).where("ts IS NOT NULL").select(
        *keys,
        "ts",
        micros(F.col("ts")).alias("at"),
        micros(F.col("ts") + F.expr(f"INTERVAL {timeout}")).alias("until"),
        F.col("event_id").cast("string").alias("event"),
        F.lit(False).alias("submit"),
    )
    right = submits.withWatermark("ts", delay).where("ts IS NOT NULL AND job_id IS NOT NULL AND batch_id IS NOT NULL").select(
        *keys,
        "ts",
        micros(F.col("ts")).alias("at"),
        micros(F.col("ts")).alias("until"),
        F.lit(None).cast("string").alias("event"),
        F.lit(True).alias("submit"),
    )
    fields = [T.StructField(c, requests.schema[c].dataType) for c in keys]
    schema = T.StructType([*fields, T.StructField("at", T.LongType()), T.StructField("event", T.StringType())])
    late = left.union(right).groupBy(*keys).applyInPandasWithState(
        _settle, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return late.select(
        *keys,
        F.timestamp_micros("at").cast(requests.schema["ts"].dataType).alias("requested_at"),
        F.col("event").cast(requests.schema["event_id"].dataType).alias("event_id"),
    )
