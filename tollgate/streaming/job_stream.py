"""The job ledger as a stream (K1, K2, K4): the state of every job is kept, not replayed.

The log of job events arrives in micro-batches, in order from one to the next.  A job's state (when
it was created, started and ended, and how) is keyed state of the query, checkpointed with it; each
event gets the verdict that ``operators.jobs.replay`` gives over the whole log, however the log is
cut.  Within a micro-batch a job's events are put in order; what a task holds of one job is bounded
by what a micro-batch admits.

Retention (K4) is a timer: ``keep_finished`` seconds of event time after it ended, a job's state
goes, and later events find no job.  Unfinished jobs stay.  Without it nothing is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tollgate.operators import jobs as JB

EVENT_COLUMNS = ("job_id", "at", "event_id", "kind", "report_error", "reason")
VERDICT_SCHEMA = ("job_id bigint, at bigint, event_id bigint, kind string, state_before string, state_after string, legal boolean, "
                  "message string, error string")
STATE_SCHEMA = "state string, ended bigint"
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def stream_events(log: DataFrame) -> DataFrame:
    """A job log (job_id, ts, event_id, kind, report_error, reason) with its time in microseconds, ``at``."""
    return log.select("job_id", F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col("ts").cast("timestamp_ntz")).alias("at"),
                      "event_id", "kind", "report_error", "reason")


def _moved(state: str | None, kind: str, broken: bool) -> str | None:
    """The state that a legal event leads to; None: it isn't one."""
    if kind == JB.CREATE:
        return JB.PENDING if state is None else None
    if state == JB.PENDING and kind == JB.START:
        return JB.PROCESSING
    if kind == JB.FAIL and state in (JB.PENDING, JB.PROCESSING):
        return JB.FAILED
    if kind == JB.COMPLETE and state == JB.PROCESSING:
        return JB.FAILED if broken else JB.COMPLETED
    return None


def _verdicts(keep_micros: int | None):
    def run(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        job = key[0]
        state, ended = kept.get if kept.exists else (None, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["at", "event_id"], kind="stable")
        out = []
        for at, event, kind, broken, reason in zip(rows["at"], rows["event_id"], rows["kind"], rows["report_error"], rows["reason"]):
            if ended is not None and keep_micros is not None and at > ended + keep_micros:
                state = ended = None  # retained until then
            broken = None if pd.isna(broken) else broken
            after = _moved(state, kind, broken is not None)
            move = kind in JB.TARGET
            message = error = None
            if move and state is None:
                message = f"Import job {job} was not found"
            elif move and after is None:
                message = f'Import job {job} cannot move from "{state}" to "{JB.TARGET[kind]}"'
            elif after == JB.FAILED:
                error = broken if kind == JB.COMPLETE else None if pd.isna(reason) else reason
            created = kind == JB.CREATE and after is not None  # the replay has a new job pending from its creation on
            out.append((job, at, event, kind, after if created else state, after or state, move and after is not None, message, error))
            if after is not None:
                state = after
                ended = at if after in (JB.COMPLETED, JB.FAILED) else None
        if state is not None:
            kept.update((state, ended))
            if ended is not None and keep_micros is not None:
                kept.setTimeoutTimestamp(max((ended + keep_micros) // 1000, kept.getCurrentWatermarkMs() + 1))
        elif kept.exists:
            kept.remove()
        names = [c.split()[0] for c in VERDICT_SCHEMA.split(", ")]
        yield pd.DataFrame(out, columns=names)

    return run


def job_verdicts(events: DataFrame, keep_finished: int | None = None) -> DataFrame:
    """A streaming frame of ``stream_events`` to a verdict per event."""
    if keep_finished is None:
        return events.groupBy("job_id").applyInPandasWithState(
            _verdicts(None), VERDICT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
    timed = events.withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", "0 seconds")
    return timed.groupBy("job_id").applyInPandasWithState(
        _verdicts(keep_finished * 1_000_000), VERDICT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def follow_jobs(log: DataFrame, verdicts: str, checkpoint: str, keep_finished: int | None = None) -> None:
    """Follow a streaming job log until it is drained: append the verdicts to the Parquet table ``verdicts``."""
    query = job_verdicts(stream_events(log), keep_finished).writeStream.format("parquet").outputMode("append") \
        .option("path", verdicts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def followed_status(verdicts: DataFrame) -> DataFrame:
    """K2 of the verdicts so far: job_id, status, created_at, started_at, finished_at and error of every job."""
    known = verdicts.where(F.col("state_after").isNotNull())
    first = lambda state: F.min(F.when(F.col("state_after").isin(*state), F.col("at")))
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.expr(EPOCH)).alias(c)
    jobs = known.groupBy("job_id").agg(
        F.max_by("state_after", F.struct("at", "event_id")).alias("status"), first((JB.PENDING,)).alias("created_at"),
        first((JB.PROCESSING,)).alias("started_at"), first((JB.COMPLETED, JB.FAILED)).alias("finished_at"), F.max("error").alias("error"))
    return jobs.select("job_id", "status", at("created_at"), at("started_at"), at("finished_at"), "error")
