"""The batch ledger as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolloom.operators.lifecycle import RECENT_TIMES, queue_limit

LEDGER_SCHEMA = (
    "job_id bigint, events bigint, pending array<bigint>, completed_count bigint, "
    "refused bigint, avg_generation_time double"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ledger(StatefulProcessor):
    """State of a job: pending ids (at most ``limit``), results that wait, recent times, counters.

    With ``expire`` (microseconds) a result not fetched, or a request not answered, for that long is retired: at the next event of
    the job by that event's time, and by a timer once the watermark has passed if no event comes. So state
    holds what is younger than ``expire``, and neither finished nor forgotten batches.
    """

    def __init__(self, limit: int, expire: int | None):
        self.limit, self.expire = limit, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.small = handle.getValueState(
            "small",
            "pending array<bigint>, since array<bigint>, times array<double>, events bigint, completed bigint, refused bigint, timer bigint",
        )
        self.waiting = handle.getMapState("waiting", "batch_id bigint", "at bigint")

    def _load(self) -> tuple[dict[int, int], list[float], int, int, int, int]:
        if not self.small.exists():
            return {}, [], 0, 0, 0, 0
        pending, since, times, *numbers = self.small.get()
        return dict(zip(pending, since)), list(times), *numbers

    def _store(self, key, pending, times, events, completed, refused, timer) -> pd.DataFrame:
        ids = sorted(pending)
        self.small.update((ids, [pending[i] for i in ids], times, events, completed, refused, timer))
        return pd.DataFrame(
            {
                "job_id": [key[0]],
                "events": [events],
                "pending": [ids],
                "completed_count": [completed],
                "refused": [refused],
                "avg_generation_time": [sum(times) / len(times) if times else 0.0],
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One job's rows of one micro-batch, whose size the source's rate limit bounds.
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], na_position="first")
        pending, times, events, completed, refused, timer = self._load()
        # Each batch id is read once, and written once if it changed. With expiry all waiting results are at hand: they are few by then.
        ids = batch["batch_id"].astype("int64").unique().tolist()
        if self.expire is None:
            before = {i: self.waiting.getValue((i,))[0] for i in ids if self.waiting.containsKey((i,))}
        else:
            before = {k[0]: v[0] for k, v in self.waiting.iterator()}
        waiting, oldest = dict(before), None
        micros = batch["ts"].astype("datetime64[us]").astype("int64")
        for batch_id, kind, at, seconds in zip(
            batch["batch_id"].astype("int64").tolist(), batch["kind"], micros.tolist(), batch["generation_time"].tolist()
        ):
            if self.expire is not None and (oldest is None or oldest + self.expire < at):
                completed -= self._retire(pending, waiting, at - self.expire)
                oldest = min([*pending.values(), *waiting.values()], default=at)
            if kind == "request":
                if batch_id not in waiting and batch_id not in pending:
                    if len(pending) < self.limit:
                        pending[batch_id] = at
                    else:
                        refused += 1
            elif kind == "submit":
                pending.pop(batch_id, None)
                times = [*times, seconds][-RECENT_TIMES:]
                completed += batch_id not in waiting
                waiting[batch_id] = at
            elif kind == "get":
                completed -= waiting.pop(batch_id, None) is not None
        self._write(before, waiting)
        timer = self._remind(timer, pending, waiting)
        yield self._store(key, pending, times, events + len(batch), completed, refused, timer)

    def _retire(self, pending: dict[int, int], waiting: dict[int, int], until: int) -> int:
        """Drop what dates from before ``until``; the number of results among it."""
        old = [i for i, at in waiting.items() if at < until]
        for table, gone in ((waiting, old), (pending, [i for i, at in pending.items() if at < until])):
            for i in gone:
                del table[i]
        return len(old)

    def _write(self, before: dict[int, int], after: dict[int, int]) -> None:
        for i in before.keys() - after.keys():
            self.waiting.removeKey((i,))
        for i, at in after.items():
            if before.get(i) != at:
                self.waiting.updateValue((i,), (at,))

    def _remind(self, timer: int, pending: dict[int, int], waiting: dict[int, int]) -> int:
        """One timer per job, for its oldest entry; its time in milliseconds, 0 for none."""
        if self.expire is None:
            return 0
        oldest = min([*pending.values(), *waiting.values()], default=None)
        wanted = 0 if oldest is None else (oldest + self.expire) // 1000 + 1
        if wanted != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if wanted:
                self.handle.registerTimer(wanted)
        return wanted

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, times, events, completed, refused, _ = self._load()
        before = {k[0]: v[0] for k, v in self.waiting.iterator()}
        waiting = dict(before)
        # the watermark may be far past the one timer of the job: all that it has passed goes at once
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        completed -= self._retire(pending, waiting, passed * 1000 - self.expire)
        self._write(before, waiting)
        yield self._store(key, pending, times, events, completed, refused, self._remind(0, pending, waiting))

    def close(self) -> None:
        pass


def batch_ledger_stream(
    events: DataFrame, max_queue_size: int | None = None, ahead: int = 1, expire: float | None = None, delay: str = "0 seconds"
) -> DataFrame:
    """After every micro-batch, the ledger of each job that had events in it.

    The row with the most ``events`` is a job's current one. Events of a job must reach
    the stream in (ts, event_id) order across micro-batches; within one they are sorted, so bound
    a micro-batch with the source's rate limit (``maxBytesPerTrigger``, ``maxFilesPerTrigger``).
    Needs the RocksDB state store (``ROCKSDB``).

    ``expire`` (seconds) retires results nobody fetched and requests nobody answered for that long, by the time of
    events, so state does not grow with them; a job without events loses them once the watermark, ``delay`` behind, has passed, and
    shows that in a row of the same ``events``.
    """
    if expire is not None:
        events = events.withWatermark("ts", delay)
    return (
        events.select("job_id", "batch_id", "kind", "ts", "event_id", "generation_time")
        .groupBy("job_id")
        .transformWithStateInPandas(
            statefulProcessor=_Ledger(queue_limit(max_queue_size, ahead), None if expire is None else round(expire * 1e6)),
            outputStructType=LEDGER_SCHEMA,
            outputMode="Update",
            timeMode="None" if expire is None else "EventTime",
        )
    )
