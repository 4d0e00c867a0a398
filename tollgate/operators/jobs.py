"""Job ledger (K1-K4) derived from an append-only event table.

The reference mutates one job object per import; here the events are data and
the state is an aggregation.  Per job, ordered by ``(ts, event_id)``:

* created at its first ``create`` event (events before it: job not found);
* the first ``start`` is legal unless a ``fail`` came first;
* after a legal start the first ``complete`` or ``fail`` finishes the job;
  without a legal start the first ``fail`` finishes it;
* a completion whose report is inconsistent (``report_error``) ends the job as failed with that text;
* every other start / complete / fail is an illegal move and changes nothing.

That is three rounds of per-job ``min`` aggregations (partial aggregation before
the shuffle) over four narrow columns, joined on the job key with
``hot_split_join`` (a job holding a third of all events joins map-side), never a
per-job window.  The events themselves are joined once, with the facts of their
job.  ``streaming.job_stream`` keeps the same facts as state of a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.skew import hot_keys, hot_split_join

# Job statuses, messages and limits of the reference.
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"
MAX_JOBS = 1000
REPORT_NOT_INTEGER = "Import report is inconsistent: row counts must be non-negative integers"
REPORT_TOO_MANY = "Import report is inconsistent: imported + errors cannot exceed the processed rows"

# event kinds of the ledger
CREATE, START, COMPLETE, FAIL = "create", "start", "complete", "fail"
TARGET = {START: PROCESSING, COMPLETE: COMPLETED, FAIL: FAILED}


def transition_error(job: Column, frm: Column, to: Column) -> Column:
    return F.concat(F.lit("Import job "), job.cast("string"), F.lit(' cannot move from "'), frm, F.lit('" to "'), to, F.lit('"'))


def not_found(job: Column) -> Column:
    return F.concat(F.lit("Import job "), job.cast("string"), F.lit(" was not found"))


def _pos() -> Column:
    return F.struct("ts", "event_id")


def _first_after(kind: str, after: str) -> Column:
    return F.min(F.when((F.col("kind") == kind) & (_pos() > F.col(after)), _pos()))


def _end_kind() -> Column:
    """How a legal end leaves the job: a completion with a broken report fails it."""
    return F.when((F.col("kind") == COMPLETE) & F.col("report_error").isNotNull(), F.lit(FAIL)).otherwise(F.col("kind"))


def replay(events: DataFrame) -> DataFrame:
    """Per event: ``state_before``, ``legal``, ``message``; per job facts are joined on.

    ``events`` columns: job_id, ts, event_id, kind (create/start/complete/fail/other), report_error
    (of a completion, NULL if its report holds), plus payload.
    """
    # every job id of the log has a row in each per-job table, so inner joins keep all events;
    # a job holding a third of the events joins map-side (see operators.skew)
    hot = hot_keys(events.groupBy("job_id").agg(F.count("*").alias("_n")), "job_id")  # same set for all joins
    narrow = events.select("job_id", "ts", "event_id", _end_kind().alias("end_kind"), "kind")
    created = narrow.groupBy("job_id").agg(F.min(F.when(F.col("kind") == CREATE, _pos())).alias("created"))
    r2 = hot_split_join(narrow, created, "job_id", hot).groupBy("job_id").agg(
        F.first("created").alias("created"),
        _first_after(START, "created").alias("first_start"),
        _first_after(FAIL, "created").alias("first_fail"),
    ).withColumn(
        "start_pos",
        F.when(F.col("first_start").isNotNull() & (F.col("first_fail").isNull() | (F.col("first_start") < F.col("first_fail"))),
               F.col("first_start")),
    )
    moves = narrow.where(F.col("kind").isin(COMPLETE, FAIL))
    r3 = hot_split_join(moves, r2.where(F.col("start_pos").isNotNull()).select("job_id", "start_pos"), "job_id", hot).groupBy("job_id").agg(
        F.min(F.when(_pos() > F.col("start_pos"), F.struct(_pos().alias("p"), F.col("end_kind").alias("k")))).alias("_end_after_start"),
    )
    end = F.when(F.col("start_pos").isNotNull(), F.col("_end_after_start")).otherwise(
        F.when(F.col("first_fail").isNotNull(), F.struct(F.col("first_fail").alias("p"), F.lit(FAIL).alias("k"))))
    facts = r2.join(r3, "job_id", "left").select("job_id", "created", "start_pos", end.alias("end"))
    e3 = hot_split_join(events, facts, "job_id", hot)
    p = _pos()
    state_before = (
        F.when(F.col("created").isNull() | (p < F.col("created")), F.lit(None).cast("string"))
        .when(F.col("end").isNotNull() & (p > F.col("end.p")), F.when(F.col("end.k") == FAIL, FAILED).otherwise(COMPLETED))
        .when(F.col("start_pos").isNotNull() & (p > F.col("start_pos")), PROCESSING)
        .otherwise(PENDING)
    )
    is_move = F.col("kind").isin(START, COMPLETE, FAIL)
    legal = is_move & ((F.col("start_pos").isNotNull() & (p == F.col("start_pos"))) | (F.col("end").isNotNull() & (p == F.col("end.p"))))
    target = F.element_at(F.create_map(*[F.lit(x) for kv in TARGET.items() for x in kv]), F.col("kind"))
    message = (
        F.when(F.col("created").isNull() | (p < F.col("created")), F.when(is_move, not_found(F.col("job_id"))))
        .when(is_move & ~legal, transition_error(F.col("job_id"), state_before, target))
    )
    return e3.withColumn("state_before", state_before).withColumn("legal", F.coalesce(legal, F.lit(False))) \
        .withColumn("message", message)


def job_status(replayed: DataFrame, requested: DataFrame | None = None, result: Sequence[str] = ()) -> DataFrame:
    """K2: one row per job id: status, timestamps, error and, of completed jobs, the ``result`` columns.

    ``requested`` (job_id) are the ids asked for; those without a job are reported as not found.
    Without it every id of the log is.
    """
    ends = F.col("legal") & F.col("kind").isin(COMPLETE, FAIL)
    jobs = replayed.groupBy("job_id").agg(
        F.first("created", ignorenulls=True).alias("_created"),
        F.first("start_pos", ignorenulls=True).alias("_start"),
        F.first("end", ignorenulls=True).alias("_end"),
        F.max(F.when(ends, F.struct(F.coalesce("report_error", F.when(F.col("kind") == FAIL, F.col("reason"))).alias("error"),
                                    *result))).alias("_last"),
    )
    if requested is not None:
        jobs = requested.select("job_id").distinct().join(jobs, "job_id", "left")
    failed = F.col("_end.k") == FAIL
    return jobs.select(
        "job_id",
        F.when(F.col("_created").isNull(), F.lit(None).cast("string"))
        .when(F.col("_end").isNotNull(), F.when(failed, FAILED).otherwise(COMPLETED))
        .when(F.col("_start").isNotNull(), PROCESSING).otherwise(PENDING).alias("status"),
        F.col("_created.ts").alias("created_at"),
        F.col("_start.ts").alias("started_at"),
        F.col("_end.p.ts").alias("finished_at"),
        F.when(F.col("_created").isNull(), not_found(F.col("job_id"))).when(failed, F.col("_last.error")).alias("error"),
        *[F.when(~failed, F.col(f"_last.{c}")).alias(c) for c in result],
    )


def report_check(processed: Column, imported: Column, errors: Column) -> Column:
    """NULL when the report is consistent, else the reason."""
    counts = [processed, imported, errors]
    not_int = None
    for c in counts:
        bad = c.isNull() | (c < 0) | (c != F.floor(c))
        not_int = bad if not_int is None else (not_int | bad)
    return F.when(not_int, F.lit(REPORT_NOT_INTEGER)).when(imported + errors > processed, F.lit(REPORT_TOO_MANY))


def retention(jobs: DataFrame, last_save: str, finished: str, limit: int = MAX_JOBS) -> DataFrame:
    """K4: keep every unfinished job and the most recently saved finished ones, at most ``limit`` in total.

    The kept finished jobs are a top-k with k <= ``limit``: a bounded TakeOrderedAndProject.
    """
    counts = jobs.agg(F.sum(F.when(F.col(finished), 0).otherwise(1)).alias("unfinished")).collect()[0]
    k = max(0, limit - int(counts["unfinished"] or 0))
    keep_finished = (
        jobs.where(F.col(finished)).orderBy(F.col(last_save).desc(), F.col("job_id").desc()).limit(k)
        .select("job_id", F.lit(True).alias("_top"))
    )
    return jobs.join(F.broadcast(keep_finished), "job_id", "left").select(
        "job_id", (~F.col(finished) | F.col("_top").isNotNull()).alias("kept"))
