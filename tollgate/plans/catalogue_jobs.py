"""Registered queries for the job ledger (``events`` as a job log), counters and the manifest.

``events`` plays the job log: job = ``user_id``, order ``(ts, event_id)``;
signup = create, view = start, purchase = complete, error = fail (its ``props``
is the failure reason), click = no state change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators import jobs as JB
from tollgate.operators.summary import rate, round1
from tollgate.plans import oracle as O
from tollgate.plans.catalogue import ORACLE, register
from tollgate.plans.catalogue_io import students_csv
from tollgate.sinks.csv_text import write_csv_files
from tollgate.sources import manifest as M
from tollgate.session import scratch_path
from tollgate.sources.fixtures import table
from tollgate.streaming.job_stream import EPOCH, VERDICT_SCHEMA, follow_jobs

KIND = {"signup": JB.CREATE, "view": JB.START, "purchase": JB.COMPLETE, "error": JB.FAIL}
RETENTION_LIMIT = 100  # 150 jobs at sf0.01, so eviction is exercised


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.lit("other")
    for ev, k in KIND.items():
        kind = F.when(F.col("event_type") == ev, F.lit(k)).otherwise(kind)
    counts = _report_counts(F.col("value"), F.col("event_id"))
    broken = F.when(kind == JB.COMPLETE, JB.report_check(*counts))
    return e.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind"), "value",
                    F.col("props").alias("reason"), broken.alias("report_error"),
                    *[c.alias(n) for n, c in zip(RESULT, counts)])


RESULT = ("total_processed", "total_imported", "total_errors")


def _report_counts(value: F.Column, event_id: F.Column) -> list[F.Column]:
    """The report of a completion: processed = value, imported = floor(value), errors = event_id % 3."""
    return [value, F.floor(value).cast("double"), (event_id % 3).cast("double")]


def _report_sql(value: str, event_id: str) -> tuple[str, str, str]:
    return value, f"CAST(floor({value}) AS DOUBLE)", f"CAST({event_id} % 3 AS DOUBLE)"


_CHECK_SQL = """CASE WHEN {p} < 0 OR {p} <> floor({p}) OR {i} < 0 OR {i} <> floor({i}) OR {e} < 0 OR {e} <> floor({e})
  THEN 'Import report is inconsistent: row counts must be non-negative integers'
  WHEN {i} + {e} > {p} THEN 'Import report is inconsistent: imported + errors cannot exceed the processed rows' END"""


def _check_sql(value: str, event_id: str) -> str:
    p, i, e = _report_sql(value, event_id)
    return _CHECK_SQL.format(p=p, i=i, e=e)


_LEDGER = f"""ev AS (
  SELECT user_id AS job_id, event_id, ts, value, props AS reason,
    CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'start' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'other' END AS kind,
    row_number() OVER (ORDER BY ts, event_id) AS pos
  FROM events),
c AS (SELECT job_id, min(CASE WHEN kind = 'create' THEN pos END) AS created FROM ev GROUP BY job_id),
e1 AS (SELECT ev.*, c.created FROM ev JOIN c USING (job_id)),
r2 AS (SELECT job_id, min(CASE WHEN kind = 'start' AND pos > created THEN pos END) AS first_start,
              min(CASE WHEN kind = 'fail' AND pos > created THEN pos END) AS first_fail FROM e1 GROUP BY job_id),
e2 AS (SELECT e1.*, r2.first_start, r2.first_fail,
         CASE WHEN first_start IS NOT NULL AND (first_fail IS NULL OR first_start < first_fail) THEN first_start END AS start_pos
       FROM e1 JOIN r2 USING (job_id)),
r3 AS (SELECT job_id, min(CASE WHEN start_pos IS NOT NULL AND kind IN ('complete', 'fail') AND pos > start_pos THEN pos END) AS end_after
       FROM e2 GROUP BY job_id),
e3 AS (SELECT e2.*, CASE WHEN start_pos IS NOT NULL THEN r3.end_after ELSE first_fail END AS end_pos FROM e2 JOIN r3 USING (job_id)),
e4 AS (SELECT e3.*, CASE WHEN x.kind = 'complete' AND ({_check_sql('x.value', 'x.event_id')}) IS NOT NULL THEN 'fail' ELSE x.kind END AS end_kind,
  CASE WHEN x.kind = 'complete' THEN {_check_sql('x.value', 'x.event_id')} ELSE x.reason END AS end_error FROM e3 LEFT JOIN ev x ON x.pos = e3.end_pos),
st AS (SELECT *,
  CASE WHEN created IS NULL OR pos < created THEN NULL
       WHEN end_pos IS NOT NULL AND pos > end_pos THEN CASE WHEN end_kind = 'fail' THEN 'failed' ELSE 'completed' END
       WHEN start_pos IS NOT NULL AND pos > start_pos THEN 'processing' ELSE 'pending' END AS state_before,
  coalesce(kind IN ('start', 'complete', 'fail') AND (pos = start_pos OR pos = end_pos), false) AS legal
  FROM e4)"""


@register(
    "job_transitions",
    f"""WITH {_LEDGER}
SELECT event_id, job_id, kind, state_before, legal,
  CASE WHEN created IS NULL OR pos < created THEN
         CASE WHEN kind IN ('start', 'complete', 'fail') THEN 'Import job ' || CAST(job_id AS VARCHAR) || ' was not found' END
       WHEN kind IN ('start', 'complete', 'fail') AND NOT legal THEN
         'Import job ' || CAST(job_id AS VARCHAR) || ' cannot move from "' || state_before || '" to "' ||
         CASE kind WHEN 'start' THEN 'processing' WHEN 'complete' THEN 'completed' ELSE 'failed' END || '"' END AS message
FROM st WHERE kind <> 'other'""",
)
def job_transitions(spark, sf_dir):
    r = JB.replay(job_log(spark, sf_dir))
    return r.where(F.col("kind") != "other").select("event_id", "job_id", "kind", "state_before", "legal", "message")


JOB_CUTS = 5  # pieces of the log that the streamed ledger takes one by one


@register("job_stream", ORACLE["job_transitions"])
def job_stream(spark, sf_dir):
    """K1 as a stream: the log arrives in pieces of time, each a micro-batch; the state of a job is kept between them."""
    log = job_log(spark, sf_dir).select("job_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "kind", "report_error", "reason")
    inbox, verdicts = scratch_path(spark, "job-log"), scratch_path(spark, "job-verdicts")
    second = F.timestamp_diff("SECOND", F.expr(EPOCH), F.col("ts"))
    lo, hi = log.agg(F.min(second), F.max(second)).first()
    for k in range(JOB_CUTS):  # one file a piece, in time
        part = log.where(F.floor((second - (lo or 0)) * JOB_CUTS / ((hi or 0) - (lo or 0) + 1)) == k)
        part.coalesce(1).write.mode("append").parquet(inbox)
    follow_jobs(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(inbox), verdicts, scratch_path(spark, "job-ckpt"))
    return spark.read.schema(VERDICT_SCHEMA).parquet(verdicts).where(F.col("kind") != "other").select(
        "event_id", "job_id", "kind", "state_before", "legal", "message")


_RESULT_SQL = ", ".join(f"CASE WHEN end_kind = 'complete' THEN {x} END AS {n}" for n, x in zip(RESULT, _report_sql("d.value", "d.event_id")))
_STATUS_SQL = f"""WITH {_LEDGER},
jobs AS (SELECT job_id, any_value(created) AS created, any_value(start_pos) AS start_pos, any_value(end_pos) AS end_pos,
                any_value(end_kind) AS end_kind, any_value(end_error) AS end_error FROM st GROUP BY job_id),
asked AS (SELECT c_custkey AS job_id FROM customer UNION SELECT user_id FROM events)
SELECT asked.job_id,
  CASE WHEN created IS NULL THEN NULL WHEN end_pos IS NOT NULL THEN CASE WHEN end_kind = 'fail' THEN 'failed' ELSE 'completed' END
       WHEN start_pos IS NOT NULL THEN 'processing' ELSE 'pending' END AS status,
  a.ts AS created_at, b.ts AS started_at, d.ts AS finished_at,
  CASE WHEN created IS NULL THEN 'Import job ' || CAST(asked.job_id AS VARCHAR) || ' was not found'
       WHEN end_kind = 'fail' THEN end_error END AS error, {_RESULT_SQL}
FROM asked LEFT JOIN jobs j ON j.job_id = asked.job_id LEFT JOIN ev a ON a.pos = j.created LEFT JOIN ev b ON b.pos = j.start_pos
LEFT JOIN ev d ON d.pos = j.end_pos"""


@register("job_status", _STATUS_SQL)
def job_status(spark, sf_dir):
    """Asked for: every job of the log and every customer key, most of which never had a job."""
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    log = job_log(spark, sf_dir)
    return JB.job_status(JB.replay(log), asked.union(log.select("job_id")), RESULT)


@register(
    "report_invariants",
    f"SELECT event_id, {_check_sql('value', 'event_id')} AS message FROM events WHERE event_type = 'purchase'",
)
def report_invariants(spark, sf_dir):
    """F4 over one report per completion event: processed = value, imported = floor(value), errors = event_id % 3."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.select("event_id", JB.report_check(*_report_counts(F.col("value"), F.col("event_id"))).alias("message"))


@register(
    "job_report_check",
    f"""WITH {_LEDGER},
ends AS (SELECT DISTINCT st.job_id, end_kind, end_error FROM st JOIN ev x ON x.pos = st.end_pos WHERE x.kind = 'complete')
SELECT job_id, CASE WHEN end_kind = 'fail' THEN 'failed' ELSE 'completed' END AS status, end_error AS error FROM ends""",
)
def job_report_check(spark, sf_dir):
    """K3: a completion whose report breaks F4 ends the job failed with that text; the job's own status says the same."""
    r = JB.replay(job_log(spark, sf_dir))
    done = r.where(F.col("legal") & (F.col("kind") == JB.COMPLETE))
    status = F.when(F.col("end.k") == JB.FAIL, JB.FAILED).otherwise(JB.COMPLETED)
    return done.select("job_id", status.alias("status"), F.col("report_error").alias("error"))


@register(
    "job_retention",
    f"""WITH {_LEDGER},
jobs AS (SELECT job_id, any_value(created) AS created, any_value(start_pos) AS start_pos, any_value(end_pos) AS end_pos FROM st GROUP BY job_id),
j2 AS (SELECT j.job_id, end_pos IS NOT NULL AS finished, x.ts AS last_save FROM jobs j
       JOIN ev x ON x.pos = coalesce(j.end_pos, j.start_pos, j.created) WHERE j.created IS NOT NULL),
k AS (SELECT greatest(0, {RETENTION_LIMIT} - (SELECT count(*) FROM j2 WHERE NOT finished)) AS k),
ranked AS (SELECT job_id, row_number() OVER (ORDER BY last_save DESC, job_id DESC) AS rk FROM j2 WHERE finished)
SELECT j2.job_id, (NOT finished OR r.rk <= (SELECT k FROM k)) AS kept FROM j2 LEFT JOIN ranked r USING (job_id)""",
)
def job_retention(spark, sf_dir):
    r = JB.replay(job_log(spark, sf_dir))
    jobs = r.groupBy("job_id").agg(
        F.first("created", ignorenulls=True).alias("created"),
        F.first("start_pos", ignorenulls=True).alias("start_pos"),
        F.first("end", ignorenulls=True).alias("end"),
    ).where(F.col("created").isNotNull()).select(
        "job_id",
        F.col("end").isNotNull().alias("finished"),
        F.coalesce(F.col("end.p.ts"), F.col("start_pos.ts"), F.col("created.ts")).alias("last_save"),
    )
    return JB.retention(jobs, "last_save", "finished", RETENTION_LIMIT)


@register(
    "rate_round",
    """SELECT user_id AS job_id, CAST(count(*) AS BIGINT) AS rows,
  CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS duration_ms,
  CAST(CASE WHEN (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 > 0
       THEN floor(count(*) * 1000.0 / ((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000) + 0.5) ELSE count(*) END AS BIGINT) AS rows_per_second,
  floor(sum(value) / 10.0 * 10.0 + 0.5) / 10.0 AS megabytes
FROM events GROUP BY user_id""",
)
def rate_round(spark, sf_dir):
    """C13 over per-job activity: rows/s rounded half up, a size to one decimal."""
    e = table(spark, sf_dir, "events")
    agg = e.groupBy(F.col("user_id").alias("job_id")).agg(
        F.count("*").cast("bigint").alias("rows"),
        # wall-clock difference of the log's timestamps, no session-zone conversion
        F.floor(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1000).cast("bigint").alias("duration_ms"),
        (F.sum("value") / 10.0).alias("_mb"),
    )
    return agg.select("job_id", "rows", "duration_ms", rate(F.col("rows"), F.col("duration_ms")).alias("rows_per_second"),
                      round1(F.col("_mb")).alias("megabytes"))


# ---- A8: input manifest -------------------------------------------------------------

SMALL_FILE = 14  # bytes of a file with a header and one row: the limit, which the students' file exceeds


_MANIFEST_SQL = f"""SELECT page_id, CASE page_id % 10
    WHEN 0 THEN NULL
    WHEN 5 THEN '{M.MSG_UNREADABLE}'
    WHEN 1 THEN CASE WHEN lower(url) LIKE '%.csv' THEN '{M.MSG_UNREADABLE}' ELSE '{M.MSG_EXTENSION}' END
    WHEN 6 THEN CASE WHEN lower(url) LIKE '%.csv' THEN '{M.MSG_UNREADABLE}' ELSE '{M.MSG_EXTENSION}' END
    WHEN 2 THEN '{M.MSG_UNREADABLE}' WHEN 7 THEN '{M.MSG_UNREADABLE}'
    WHEN 3 THEN '{M.MSG_REQUIRED}' WHEN 8 THEN '{M.MSG_REQUIRED}'
    WHEN 9 THEN '{M.too_large(SMALL_FILE)}'
    ELSE '{M.MSG_INVALID_CHARS}' END AS message
FROM pages"""


@register("input_manifest", _MANIFEST_SQL)
def input_manifest(spark, sf_dir):
    """Candidate paths derived from ``pages``: a small file, a file beyond the limit, its directory, the URL
    as is, the URL with an upper-case .CSV suffix (missing file), a blank path, and a path with a NUL."""
    root, small_root = students_csv(spark, sf_dir), scratch_path(spark, "small") + ".csv"
    first = table(spark, sf_dir, "region").where(F.col("r_regionkey") == 0)
    small = write_csv_files(first, small_root, ["r_regionkey"], "r_regionkey")[0]
    files = M.listing(spark, [root, small_root])
    real = files.where(F.col("size_bytes") > SMALL_FILE).agg(F.min("_lpath")).first()[0]
    p = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 10
    cand = (
        F.when(kind == 0, F.lit(small))
        .when(kind == 9, F.lit(real))
        .when(kind == 5, F.lit(root))
        .when(kind.isin(1, 6), F.col("url"))
        .when(kind.isin(2, 7), F.concat(F.lit(root), F.lit("/"), F.col("page_id").cast("string"), F.lit(".CSV")))
        .when(kind.isin(3, 8), F.lit("   "))
        .otherwise(F.concat(F.col("url"), F.lit("\u0000"), F.lit(".csv")))
    )
    out = M.classify_paths(p.select("page_id", cand.alias("candidate")), "candidate", files, SMALL_FILE)
    return out.select("page_id", "message")
