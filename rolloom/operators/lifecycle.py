"""Job logs, statuses and the life of batches, over stored events.

A batch event is ``job_id, batch_id, kind, ts, event_id, generation_time`` with kind ``request``,
``submit`` or ``get``; a job's events are ordered by (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.functions.names import COMPONENT_NAMES, component_name, is_terminal, level_name, training_status
from rolloom.plans.ordered import previous_value, row_chunks, running, top_rows, trailing_mean
from rolloom.session import materialize

ORDER = ["ts", "event_id"]
BATCH = ["job_id", "batch_id"]
RECENT_TIMES = 100


def parse_log(df: DataFrame, message: str = "message") -> DataFrame:
    """Split ``text | {json}`` at the last space-bar-space into ``message`` and ``context`` (VARIANT).

    The message stays whole unless it ends in ``}`` and the tail is valid JSON.
    """
    m = F.col(message)
    structured = m.contains(" | {") & m.endswith("}")
    tail = F.try_parse_json(F.when(structured, F.regexp_extract(m, r"(?s)^.* \| (.*)$", 1)))
    head = F.regexp_extract(m, r"(?s)^(.*) \| .*$", 1)
    return df.withColumn("context", tail).withColumn(
        message, F.when(F.col("context").isNotNull(), head).otherwise(m)
    )


def short_names(df: DataFrame, mapping: Mapping[str, str] = COMPONENT_NAMES) -> DataFrame:
    """Add ``component`` (at most 10 characters) and ``level4`` from ``logger`` and ``level``."""
    return df.withColumns(
        {"component": component_name(F.col("logger"), mapping), "level4": level_name(F.col("level"))}
    )


def status_changes(df: DataFrame, job: Sequence[str] = ("job_id",)) -> DataFrame:
    """Rows whose status differs from the job's previous observation; its first row counts.

    A null status is observed as ``unknown``; ``previous_status`` is null in the first row only.
    """
    known, at = row_chunks(df.withColumn("status", F.coalesce("status", F.lit("unknown"))), job, "ts")
    seen = previous_value(known, job, ORDER, at, F.col("status"), "previous_status")
    return seen.where(~F.col("status").eqNullSafe(F.col("previous_status"))).drop("_rows_at")


def map_status(df: DataFrame, status: str = "status") -> DataFrame:
    """Add ``training_status``, ``terminal`` and ``unmapped``."""
    mapped = training_status(F.col(status))
    return df.withColumns(
        {
            "training_status": mapped,
            "terminal": F.coalesce(is_terminal(mapped), F.lit(False)),
            "unmapped": mapped.isNull(),
        }
    )


def latest_event(events: DataFrame, shown: DataFrame | None = None, job: str = "job_id") -> DataFrame:
    """The newest event of each job, left out where ``shown`` (job, event_id) already has it."""
    others = [c for c in events.columns if c != job]
    newest = (
        events.groupBy(job)
        .agg(F.max_by(F.struct(*others), F.struct(*ORDER)).alias("_e"))
        .select(job, "_e.*")
    )
    return newest if shown is None else newest.join(shown.select(job, "event_id"), [job, "event_id"], "left_anti")


def queue_limit(max_queue_size: int | None = None, ahead: int = 1) -> int:
    return max_queue_size or max(2 * ahead, 4)


def batch_flags(events: DataFrame) -> DataFrame:
    """Per batch, without a queue limit: was it requested, submitted and fetched, and is it pending.

    Pending: the last event among its requests and submits is a request made while no
    result was waiting.
    """
    return _final_state(_with_waiting(*row_chunks(events, BATCH, "ts", "_batch_at")))


def _with_waiting(events: DataFrame, at: Column | None) -> DataFrame:
    """Add ``waiting``: just before the event, a submitted result of the batch was not yet fetched."""
    moved = F.when(F.col("kind").isin("submit", "get"), F.struct(*ORDER, F.col("kind")))
    seen = running(events, BATCH, ORDER, at, {"_moved": ("max", moved)}, False)
    return seen.withColumn("waiting", F.coalesce(F.col("_moved.kind") == "submit", F.lit(False))).drop("_moved")


def _opens() -> Column:
    return (F.col("kind") == "request") & ~F.col("waiting")


def _final_state(events: DataFrame, opens: Column | None = None) -> DataFrame:
    opens = _opens() if opens is None else opens
    at = F.struct(*ORDER)
    return events.groupBy("job_id", "batch_id").agg(
        (F.count_if(F.col("kind") == "request") > 0).alias("requested"),
        (F.count_if(F.col("kind") == "submit") > 0).alias("submitted"),
        F.coalesce(
            F.max_by(opens, F.when(opens | (F.col("kind") == "submit"), at)), F.lit(False)
        ).alias("pending"),
        F.coalesce(
            F.max_by(F.col("kind") == "submit", F.when(F.col("kind").isin("submit", "get"), at)), F.lit(False)
        ).alias("completed"),
    )


def decide_requests(events: DataFrame, limit: int) -> DataFrame:
    """Add ``accepted`` to every event; only a request met by a full pending set is refused.

    Whether a result is waiting does not depend on refusals, so it is computed first,
    per batch. Then the pending sets are counted as if there were no limit: the real
    set is always a part of that *open* set. A job whose open set never exceeds the limit
    has no refusals. In the other jobs a batch is *unsure* from entering an open set beyond
    the limit until it is submitted, or requested again within the limit. While no
    batch is unsure the real set equals the open set, so nothing is refused and the
    state is known. Only the stretches in between are replayed in order.

    Keys too large for a task are cut by rows. Steps over such keys read the one before twice, so their narrow results
    are stored; without them the first two steps are windows over one shuffle.
    """
    submit = F.col("kind") == "submit"
    placed, job_at = row_chunks(events, ["job_id"], "ts", "_job_at")
    placed, batch_at = row_chunks(placed, BATCH, "ts", "_batch_at")
    kept = [c for c in ("_job_at", "_batch_at") if c in placed.columns]
    waiting = _with_waiting(placed, batch_at)
    waiting = waiting if batch_at is None else materialize(waiting, "ledger-waiting")
    moves = F.when(_opens() | submit, F.struct(*ORDER, _opens().alias("open")))
    was_open = F.coalesce(F.col("_before.open"), F.lit(False))
    delta = F.when(_opens() & ~F.col("_was_open"), 1).when(submit & F.col("_was_open"), -1).otherwise(0)
    stepped = (
        running(waiting, BATCH, ORDER, batch_at, {"_before": ("max", moves)}, False)
        .withColumn("_was_open", was_open)
        .withColumn("_delta", delta)
        .drop("_before")
    )
    stepped = materialize(stepped, "ledger-steps")
    counted = materialize(
        running(stepped, ["job_id"], ORDER, job_at, {"_open": ("sum", F.col("_delta"))}), "ledger-open"
    )

    columns = [*events.columns, "waiting"]
    full = counted.where(F.col("_open") > limit).select("job_id").distinct()
    calm = counted.join(full, "job_id", "left_anti").select(*columns, F.lit(True).alias("accepted"))
    tight = counted.join(full, "job_id", "left_semi")

    enters = F.col("_delta") == 1
    settles = submit | (_opens() & (F.col("_open") <= limit))
    sure = {
        "_sure": ("max", F.when(enters | settles, F.struct(*ORDER, (enters & ~settles).alias("unsure")))),
        "_entered": ("max", F.when(enters, F.struct(*ORDER))),
    }
    was_unsure = F.coalesce(F.col("_sure.unsure"), F.lit(False))
    change = F.when(enters & ~settles, 1).when(settles & was_unsure, -1).otherwise(0)
    marked = running(tight, BATCH, ORDER, batch_at, sure, False).select(
        *columns, *kept, "_was_open", "_delta", "_open", change.alias("_change"),
        F.col("_entered.ts").alias("_entered_ts"), F.col("_entered.event_id").alias("_entered_id"),
    )
    marked = materialize(marked, "ledger-unsure")
    unsure = materialize(
        running(marked, ["job_id"], ORDER, job_at, {"_unsure": ("sum", F.col("_change"))}), "ledger-stretches"
    )
    settled = F.when(F.col("_unsure") == 0, 1).otherwise(0)
    cut = running(unsure, ["job_id"], ORDER, job_at, {"_stretch": ("sum", settled)}, False).withColumn(
        "_stretch", F.coalesce("_stretch", F.lit(0))
    )
    open_question = (F.col("_unsure") > 0) | (F.col("_unsure") - F.col("_change") > 0)
    known = unsure.where(~open_question).select(*columns, F.lit(True).alias("accepted"))
    replayed = _replay(cut.where(open_question), limit).select(*columns, "accepted")
    return calm.unionByName(known).unionByName(replayed)


def _replay(events: DataFrame, limit: int) -> DataFrame:
    """Fold over sorted events, a batch of rows at a time.

    When a stretch starts the pending set equals the open set, so its size is known and a
    batch belongs to it if it is open and entered before. The state is that size and the
    ids accepted since, at most ``limit``.
    """

    used = ["job_id", "_stretch", "ts", "event_id", "batch_id", "kind", "waiting",
            "_was_open", "_open", "_delta", "_entered_ts", "_entered_id"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, start, size, added = None, None, 0, set()
        for rows in batches:
            accepted = []
            for job, stretch, ts, event, batch, kind, waiting, was_open, now_open, delta, *entered in zip(
                *(rows[c] for c in used)
            ):
                if (job, stretch) != current:
                    current, start = (job, stretch), (ts, event)
                    size, added = now_open - delta, set()
                inside, ok = batch in added or (was_open and tuple(entered) < start), True
                if kind == "submit" and inside:
                    added.discard(batch)
                    size -= 1
                elif kind == "request" and not waiting and not inside:
                    ok = bool(size < limit)
                    if ok:
                        added.add(batch)
                        size += 1
                accepted.append(ok)
            yield rows.assign(accepted=accepted)

    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">")
    ordered = events.repartition("job_id", "_stretch").sortWithinPartitions("job_id", "_stretch", *ORDER)
    return ordered.mapInPandas(fold, f"{schema},accepted:boolean")


def batch_ledger(events: DataFrame, max_queue_size: int | None = None, ahead: int = 1) -> DataFrame:
    """Per job at the end of its events: ``pending``, ``pending_count``, ``completed_count``,
    ``refused`` and ``should_request`` (fewer open batches than ``ahead``).

    The pending ids, at most the queue limit, are in ascending order.
    """
    decided = materialize(decide_requests(events, queue_limit(max_queue_size, ahead)), "ledger-decisions")
    refused = decided.groupBy("job_id").agg(F.count_if(~F.col("accepted")).alias("refused"))
    state = _final_state(decided, _opens() & F.col("accepted"))
    summary = state.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("pending"), F.col("batch_id")))).alias("pending"),
        F.count_if("completed").alias("completed_count"),
    )
    return summary.join(refused, "job_id").select(
        "job_id",
        "pending",
        F.size("pending").alias("pending_count"),
        "completed_count",
        "refused",
        (F.size("pending") + F.col("completed_count") < ahead).alias("should_request"),
    )


def overdue(events: DataFrame, timeout_seconds: float, now: Column | None = None) -> DataFrame:
    """Batches whose first request was not followed by a submit within the timeout.

    With ``now`` a request still inside its timeout is not reported.
    """
    request = F.min(F.when(F.col("kind") == "request", F.col("ts"))).alias("requested_at")
    requests = events.groupBy("job_id", "batch_id").agg(request).where("requested_at IS NOT NULL")
    limit = F.make_dt_interval(secs=F.lit(timeout_seconds))
    submits = events.where("kind = 'submit'").select("job_id", "batch_id", F.col("ts").alias("_submit"))
    answered = (
        submits.join(requests, ["job_id", "batch_id"])
        .where((F.col("_submit") >= F.col("requested_at")) & (F.col("_submit") <= F.col("requested_at") + limit))
        .select("job_id", "batch_id")
    )
    late = requests.join(answered, ["job_id", "batch_id"], "left_anti")
    return late if now is None else late.where(F.col("requested_at") + limit < now)


def generation_times(events: DataFrame, rows: int = RECENT_TIMES) -> DataFrame:
    """Every submit with the mean generation time of the job's last ``rows`` submits."""
    submits, at = row_chunks(events.where("kind = 'submit'"), ["job_id"], "ts")
    means = trailing_mean(submits, ["job_id"], ORDER, at, F.col("generation_time"), rows, "avg_generation_time")
    return means.drop("_rows_at")


def avg_generation_time(events: DataFrame, rows: int = RECENT_TIMES) -> DataFrame:
    """Per job, the mean of the last ``rows`` submitted times; 0 for a job without submits."""
    last = top_rows(events.where("kind = 'submit'"), ["job_id"], [F.col(c).desc() for c in ORDER], rows, "_rank")
    means = last.groupBy("job_id").agg(F.avg("generation_time").alias("_mean"))
    jobs = events.select("job_id").distinct()
    return jobs.join(means, "job_id", "left").select(
        "job_id", F.coalesce("_mean", F.lit(0.0)).alias("avg_generation_time")
    )
