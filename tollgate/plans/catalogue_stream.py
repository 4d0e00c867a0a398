"""Registered queries for the whole-file import (report, summary) and the streaming import.

Streaming inputs are ``raw_students`` cut into files of ``STREAM_ROWS_PER_FILE``
consecutive rows (every row kept), dropped into a fresh inbox with increasing
modification times so the file source sees them in order.
"""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tollgate.functions import rules as R
from tollgate.plans import oracle as O
from tollgate.plans.catalogue import register
from tollgate.plans.catalogue_io import ROWS_PER_FILE, _CELLS, _FILE_RAW, students_csv
from tollgate.plans.catalogue_store import RUN_TS, seeded_target
from tollgate.plans.pipeline import import_csv
from tollgate.session import _fs, scratch_path
from tollgate.sinks.csv_text import write_csv_files
from tollgate.sources.fixtures import raw_students
from tollgate.streaming.stream import stream_import

STREAM_ROWS_PER_FILE = 5000

# the CSV fixture as the import sees it: blank records dropped, short records padded with ''
_CSV_RAW = f"SELECT file_line AS line_number, {_CELLS} FROM ({_FILE_RAW}) f WHERE NOT is_blank"


def _esc(x: str) -> str:
    guarded = (f"CASE WHEN regexp_matches({x}, {O.q(r'^[=+\-@\t\r]')}) AND NOT regexp_matches({x}, {O.q(r'^[+-]?\d+(\.\d+)?\z')}) "
               f"THEN '''' || {x} ELSE {x} END")
    return f"""CASE WHEN regexp_matches({guarded}, '[",\\r\\n]') THEN '"' || replace({guarded}, '"', '""') || '"' ELSE {guarded} END"""


def _import_fixture(spark: SparkSession, sf_dir: str, report_dir: str | None = None):
    target = seeded_target(spark, sf_dir)
    return import_csv(spark, students_csv(spark, sf_dir), target, 1000, report_dir=report_dir, run_ts=RUN_TS)


@register(
    "error_report",
    O.with_outcome(
        "SELECT 'line_number,field,value,error_message' AS line UNION ALL "
        f"SELECT CAST(line_number AS VARCHAR) || ',' || {_esc('field')} || ',' || {_esc('value')} || ',' || {_esc('message')} FROM rej",
        raw_sql=_CSV_RAW,
    ),
)
def error_report(spark, sf_dir):
    """Import the CSV fixture, write the report, read its lines back."""
    report_dir = scratch_path(spark, "reports")
    res = _import_fixture(spark, sf_dir, report_dir)
    return spark.read.text(res.error_report_path).select(F.col("value").alias("line"))


@register(
    "report_path",
    O.with_outcome(
        "SELECT CAST(attempt AS BIGINT) AS attempt, name, (SELECT CAST(count(*) + 1 AS BIGINT) FROM rej) AS lines FROM "
        "(SELECT 0 AS attempt, 'errors-2026-01-01T00-00-00-000Z.csv' AS name UNION ALL SELECT 1, 'errors-2026-01-01T00-00-00-000Z-1.csv')",
        raw_sql=_CSV_RAW,
    ),
)
def report_path(spark, sf_dir):
    """Two runs stamped in the same millisecond get errors-<stamp>.csv and errors-<stamp>-1.csv."""
    from tollgate.operators.report import rejections
    from tollgate.plans.pipeline import outcome
    from tollgate.sinks.csv_text import write_report
    from tollgate.sinks.table import snapshot_keys
    from tollgate.sources import csv_scan as S

    report_dir = scratch_path(spark, "reports")
    target = seeded_target(spark, sf_dir)
    raw = S.scan_csv(spark, students_csv(spark, sf_dir))
    rej = rejections(outcome(raw, snapshot_keys(spark, target), 1000, partition_cols=["file_seq"]), ["file_seq"])
    rows = []
    for attempt in range(2):
        path = write_report(rej, report_dir, RUN_TS, ["file_seq"])
        rows.append((attempt, path.rsplit("/", 1)[-1], path))
    counts = [spark.read.text(p).count() for _, _, p in rows]
    return spark.createDataFrame([(a, n, c) for (a, n, _), c in zip(rows, counts)], "attempt bigint, name string, lines bigint")


@register(
    "summary_output",
    O.with_outcome(
        "SELECT CAST(count(*) AS BIGINT) AS total_processed, "
        "CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS total_imported, "
        "CAST(sum(CASE WHEN status <> 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS total_errors, "
        "sum(CASE WHEN status <> 'unique' THEN 1 ELSE 0 END) > 0 AS has_error_report, false AS aborted, "
        "CAST(least(100, (SELECT count(*) FROM rej)) AS BIGINT) AS sample_size FROM oc2",
        raw_sql=_CSV_RAW,
    ),
)
def summary_output(spark, sf_dir):
    """The import result of the CSV fixture as one row (timings left out: not reproducible)."""
    res = _import_fixture(spark, sf_dir, scratch_path(spark, "reports"))
    return spark.createDataFrame(
        [(res.total_processed, res.total_imported, res.total_errors, res.error_report_path is not None, res.aborted,
          len(res.errors))],
        "total_processed bigint, total_imported bigint, total_errors bigint, has_error_report boolean, aborted boolean, "
        "sample_size bigint",
    )


# ---- streaming --------------------------------------------------------------------------

def make_inbox(spark: SparkSession, sf_dir: str, bad_header_last: bool = False) -> tuple[str, int]:
    raw = raw_students(spark, sf_dir).withColumn("_k", F.col("line_number") - 2)
    cols = ["name", "email", "enrollment_date", "course_id", "score"]
    inbox = scratch_path(spark, "inbox")
    files = write_csv_files(raw, inbox, cols, "_k", STREAM_ROWS_PER_FILE)
    if bad_header_last:
        bad = scratch_path(spark, "badfile")
        # the same rows under a header that lacks three required columns, as one file
        files += write_csv_files(raw, bad, ["name", "email"], "_k", ROWS_PER_FILE, header="label,email,score")
        # move the bad file into the inbox (metadata rename on the cluster filesystem)
        src, fs = _fs(spark, files[-1])
        dst = inbox + "/part=zzzzzz/bad.csv"
        fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(inbox + "/part=zzzzzz"))
        fs.rename(src, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dst))
        files[-1] = dst
    base = int(time.time() * 1000) - 3_600_000
    for i, f in enumerate(files):  # the file source takes files oldest first
        p, fs = _fs(spark, f)
        fs.setTimes(p, base + i * 1000, -1)
    return inbox, len(files)


def _stream(spark, sf_dir, **kw):
    inbox, n = make_inbox(spark, sf_dir, bad := kw.pop("bad_header_last", False))
    target = kw.pop("target", None) or seeded_target(spark, sf_dir)
    run = stream_import(spark, inbox, target, scratch_path(spark, "ckpt"), scratch_path(spark, "ledger"),
                        run_ts=dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc), **kw)
    return run if bad else run.checked(), target, inbox, n


_STREAM_RAW = (f"SELECT (line_number - 2) % {STREAM_ROWS_PER_FILE} + 2 AS line_number, "
               f"CAST((line_number - 2) // {STREAM_ROWS_PER_FILE} AS INTEGER) AS file_seq, name, email, enrollment_date, course_id, score "
               f"FROM ({O.RAW_STUDENTS})")
_STREAM = f"WITH {O.files_outcome_ctes(_STREAM_RAW)}\n"


@register(
    "stream_import",
    _STREAM + f"SELECT name_norm AS name, email_norm AS email, CAST(date_norm AS DATE) AS enrollment_date, course_norm AS course_id, "
    f"{O.score_value('score_norm')} AS score FROM oc2 WHERE status = 'unique'",
)
def stream_import_q(spark, sf_dir):
    """All inbox files in one micro-batch, flush key (file, batch)."""
    from tollgate.sinks.table import read_target

    run, target, _, _ = _stream(spark, sf_dir)
    t = read_target(spark, target).where(F.col("created_at") == F.lit(RUN_TS).cast("timestamp"))
    return t.select("name", "email", "enrollment_date", "course_id", F.col("score").cast("double").alias("score"))


def _file_seq(files_col):
    return F.regexp_extract(files_col, r"part=(\d+)", 1).cast("int")


@register(
    "stream_ingest",
    _STREAM + "SELECT file_seq, CAST(count(*) AS BIGINT) AS processed, CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS imported, "
    "CAST(sum(CASE WHEN status <> 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM oc2 GROUP BY file_seq",
)
def stream_ingest(spark, sf_dir):
    """A13 + J3: one file per micro-batch (maxFilesPerTrigger = 1); the ledger per file."""
    run, *_ = _stream(spark, sf_dir, max_files_per_trigger=1)
    return run.ledger.select(_file_seq(F.col("first_file")).alias("file_seq"), "processed", "imported", "errors")


@register(
    "stream_rate_limit",
    _STREAM + "SELECT CAST(count(DISTINCT file_seq) AS BIGINT) AS micro_batches, CAST(1 AS BIGINT) AS max_files_per_batch FROM oc2",
)
def stream_rate_limit(spark, sf_dir):
    run, *_ = _stream(spark, sf_dir, max_files_per_trigger=1)
    return run.ledger.agg(
        F.count("*").cast("bigint").alias("micro_batches"),
        F.max("n_files").cast("bigint").alias("max_files_per_batch"),
    )


@register(
    "stream_idempotent",
    _STREAM + "SELECT CAST(count(*) AS BIGINT) AS processed, CAST(0 AS BIGINT) AS imported, CAST(count(*) AS BIGINT) AS errors FROM oc2",
)
def stream_idempotent(spark, sf_dir):
    """The same inbox imported again (fresh checkpoint) inserts nothing; every row is rejected."""
    run, target, inbox, _ = _stream(spark, sf_dir)
    again = stream_import(spark, inbox, target, scratch_path(spark, "ckpt"), scratch_path(spark, "ledger"),
                          run_ts=dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc)).checked()
    return again.ledger.agg(F.sum("processed").cast("bigint").alias("processed"),
                            F.sum("imported").cast("bigint").alias("imported"),
                            F.sum("errors").cast("bigint").alias("errors"))


@register(
    "stream_stop",
    _STREAM + "SELECT CAST(1 AS BIGINT) AS committed_before_stop, count(DISTINCT file_seq) > 1 AS aborted, "
    "CAST(sum(CASE WHEN status = 'unique' AND file_seq = 0 THEN 1 ELSE 0 END) AS BIGINT) AS imported_before_stop, "
    "CAST(count(DISTINCT file_seq) AS BIGINT) AS committed, CAST(count(*) AS BIGINT) AS processed, "
    "CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS imported FROM oc2",
)
def stream_stop(spark, sf_dir):
    """Abort after the first micro-batch; a restart from the same checkpoint takes up all that is left."""
    inbox, _ = make_inbox(spark, sf_dir)
    target, ckpt, ledger = seeded_target(spark, sf_dir), scratch_path(spark, "ckpt"), scratch_path(spark, "ledger")
    run_ts = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    sums = [F.count("*").alias("n"), F.sum("processed").alias("processed"), F.sum("imported").alias("imported")]
    first = stream_import(spark, inbox, target, ckpt, ledger, max_files_per_trigger=1, abort_after=1, run_ts=run_ts).checked()
    before = first.ledger.where("status = 'committed'").agg(*sums).first()
    rest = stream_import(spark, inbox, target, ckpt, ledger, max_files_per_trigger=1, run_ts=run_ts).checked()
    after = rest.ledger.where("status = 'committed'").agg(*sums).first()
    return spark.createDataFrame(
        [(before["n"], first.aborted, before["imported"], after["n"], after["processed"], after["imported"])],
        "committed_before_stop bigint, aborted boolean, imported_before_stop bigint, committed bigint, processed bigint, imported bigint",
    )


@register(
    "stream_failure",
    f"SELECT 'Import failed after ' || CAST(count(*) AS VARCHAR) || ' rows: CSV header is missing required columns: name, enrollment_date, course_id' AS message, "
    f"CAST(count(*) AS BIGINT) AS committed_rows, CAST(1 AS BIGINT) AS failed_files FROM ({O.RAW_STUDENTS})",
)
def stream_failure(spark, sf_dir):
    """A file with a bad header fails alone, in a micro-batch with all the others; their rows are committed."""
    run, *_ = _stream(spark, sf_dir, bad_header_last=True)
    done = run.ledger.agg(F.sum("processed").cast("bigint").alias("committed_rows"),
                          F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed_files"))
    return done.select(F.lit(run.failure).alias("message"), "committed_rows", "failed_files")


_FIELDS = [("name", "name"), ("email", "email"), ("enrollment_date", "date"), ("course_id", "course"), ("score", "score")]
_REPORTED = " UNION ALL ".join(
    [f"SELECT file_seq, line_number, '{field}' AS field, {col}_raw AS value, {col}_error AS message FROM oc2 WHERE {col}_error IS NOT NULL"
     for field, col in _FIELDS]
    + [f"SELECT file_seq, line_number, 'email', email_norm, CASE WHEN status = 'existing' THEN {O.q(R.MSG['dup_existing'])} "
       f"ELSE {O.q(R.MSG['dup_file'])} END FROM oc2 WHERE status IN ('existing', 'file')"])


@register(
    "stream_report",
    _STREAM + f", rej AS ({_REPORTED}) SELECT DISTINCT file_seq, 'line_number,field,value,error_message' AS line FROM rej UNION ALL "
    f"SELECT file_seq, CAST(line_number AS VARCHAR) || ',' || {_esc('field')} || ',' || {_esc('value')} || ',' || {_esc('message')} FROM rej",
)
def stream_report(spark, sf_dir):
    """B3 in streaming: a report folder per file, read back."""
    report_dir = scratch_path(spark, "stream-reports")
    _stream(spark, sf_dir, report_dir=report_dir)
    return spark.read.text(report_dir).select(F.col("file").cast("int").alias("file_seq"), F.col("value").alias("line"))


# ---- stop inside a file, admission by bytes, samples and reports by file -----------------

STOP_STEP = 1000


@register(
    "import_stop",
    O.with_outcome(
        f"SELECT any_value(CASE WHEN valid_all >= {STOP_STEP} THEN true ELSE false END) AS aborted, "
        "CAST(sum(CASE WHEN first THEN 1 ELSE 0 END) AS BIGINT) AS processed_before_stop, "
        "CAST(sum(CASE WHEN first AND status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS imported_before_stop, "
        "CAST(sum(CASE WHEN first THEN 0 ELSE 1 END) AS BIGINT) AS processed_after, "
        "CAST(sum(CASE WHEN NOT first AND status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS imported_after, "
        "CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS stored "
        f"FROM (SELECT *, valid_all < {STOP_STEP} OR line_number <= (SELECT min(line_number) FROM oc2 WHERE is_valid AND valid_through = {STOP_STEP}) AS first "
        "FROM (SELECT *, max(valid_through) OVER () AS valid_all FROM oc2))",
        raw_sql=_CSV_RAW,
    ),
)
def import_stop(spark, sf_dir):
    """An import is stopped inside its file after the first step and goes on at the next row."""
    from tollgate.sinks.table import read_target

    target, path, progress = seeded_target(spark, sf_dir), students_csv(spark, sf_dir), scratch_path(spark, "progress")
    kw = dict(batch_size=1000, run_ts=RUN_TS, progress=progress, step_rows=STOP_STEP)
    first = import_csv(spark, path, target, should_stop=lambda rows: rows >= STOP_STEP, **kw)
    rest = import_csv(spark, path, target, **kw)
    stored = read_target(spark, target).where(F.col("created_at") == F.lit(RUN_TS).cast("timestamp")).count()
    return spark.createDataFrame(
        [(first.aborted, first.total_processed, first.total_imported, rest.total_processed, rest.total_imported, stored)],
        "aborted boolean, processed_before_stop bigint, imported_before_stop bigint, processed_after bigint, imported_after bigint, stored bigint")


@register(
    "stream_stop_inside",
    _STREAM + f"SELECT max(valid_through) >= {STOP_STEP} AS aborted, CAST(0 AS BIGINT) AS entered_before, CAST(count(*) AS BIGINT) AS processed, "
    "CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS imported, "
    "CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS stored FROM oc2",
)
def stream_stop_inside(spark, sf_dir):
    """J4 in a stream: a stop inside a micro-batch's first file; a restart goes on in the same micro-batch."""
    from tollgate.sinks.table import read_target

    inbox, _ = make_inbox(spark, sf_dir)
    target, ckpt, ledger = seeded_target(spark, sf_dir), scratch_path(spark, "ckpt"), scratch_path(spark, "ledger")
    kw = dict(run_ts=RUN_TS, step_rows=STOP_STEP)
    first = stream_import(spark, inbox, target, ckpt, ledger, should_stop=lambda rows: rows >= STOP_STEP, **kw).checked()
    before = first.ledger.count() if first.aborted else 0
    rest = stream_import(spark, inbox, target, ckpt, ledger, **kw).checked()
    r = rest.ledger.agg(F.sum("processed"), F.sum("imported")).first()
    stored = read_target(spark, target).where(F.col("created_at") == F.lit(RUN_TS).cast("timestamp")).count()
    return spark.createDataFrame([(first.aborted, before, r[0], r[1], stored)],
                                 "aborted boolean, entered_before bigint, processed bigint, imported bigint, stored bigint")


@register(
    "stream_byte_limit",
    _STREAM + "SELECT true AS within_bound, CAST(count(DISTINCT file_seq) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS processed FROM oc2",
)
def stream_byte_limit(spark, sf_dir):
    """Micro-batches of at most twice the largest file's bytes; the ledger has the bytes of each."""
    inbox, _ = make_inbox(spark, sf_dir)
    largest = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inbox).agg(F.max("length")).first()[0]
    run = stream_import(spark, inbox, seeded_target(spark, sf_dir), scratch_path(spark, "ckpt"), scratch_path(spark, "ledger"),
                        run_ts=RUN_TS, max_bytes_per_trigger=2 * largest).checked()
    return run.ledger.agg((F.max("n_bytes") <= 2 * largest).alias("within_bound"), F.sum("n_files").cast("bigint").alias("files"),
                          F.sum("processed").cast("bigint").alias("processed"))


_REPORTED_ORDER = " UNION ALL ".join(
    [f"SELECT file_seq, batch_no, 0 AS dup, line_number, {i} AS ord_field, '{field}' AS field, {col}_raw AS value, {col}_error AS message FROM oc2 WHERE {col}_error IS NOT NULL"
     for i, (field, col) in enumerate(_FIELDS, 1)]
    + [f"SELECT file_seq, batch_no, 1, line_number, 2, 'email', email_norm, CASE WHEN status = 'existing' THEN {O.q(R.MSG['dup_existing'])} "
       f"ELSE {O.q(R.MSG['dup_file'])} END FROM oc2 WHERE status IN ('existing', 'file')"])
_SAMPLED = (f"rej AS ({_REPORTED_ORDER}), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_seq ORDER BY batch_no, dup, line_number, ord_field) AS rk FROM rej)")


@register("file_samples", _STREAM + f", {_SAMPLED} SELECT file_seq, line_number, field, value, message FROM ranked WHERE rk <= 100")
def file_samples_q(spark, sf_dir):
    """H1 per file: an import of several files returns the first 100 violations of each."""
    inbox, _ = make_inbox(spark, sf_dir)
    res = import_csv(spark, inbox, seeded_target(spark, sf_dir), 1000, run_ts=RUN_TS)
    if not res.errors:
        return spark.createDataFrame([], "file_seq int, line_number bigint, field string, value string, message string")
    return res.file_errors.rows.select("file_seq", "line_number", "field", "value", "message")


@register("stream_samples", _STREAM + f", {_SAMPLED} SELECT file_seq, line_number, field, value, message FROM ranked WHERE rk <= 100")
def stream_samples(spark, sf_dir):
    """H1 in streaming: the first 100 violations of each file, a micro-batch a file."""
    run, *_ = _stream(spark, sf_dir, max_files_per_trigger=1)
    return run.samples.select(_file_seq(F.col("file_path")).alias("file_seq"), "line_number", "field", "value", "message")


_WARN_DETAIL = "string_agg(field || ': ' || message, '; ' ORDER BY ord_field)"


@register(
    "file_warnings",
    _STREAM + f", rej AS ({_REPORTED_ORDER}), by_row AS (SELECT file_seq, batch_no, dup, line_number, {_WARN_DETAIL} AS detail FROM rej "
    "GROUP BY file_seq, batch_no, dup, line_number), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_seq ORDER BY batch_no, dup, line_number) AS rk FROM by_row) "
    "SELECT file_seq, CAST(rk AS BIGINT) AS warn_seq, line_number, detail FROM ranked WHERE rk <= 100",
)
def file_warnings_q(spark, sf_dir):
    """H2 per file: the first 100 rejected rows of each file with their messages."""
    from tollgate.operators.report import file_warnings
    from tollgate.plans.pipeline import keep_validated, scan_outcome
    from tollgate.sinks.table import snapshot_keys
    from tollgate.sources import csv_scan as S

    inbox, _ = make_inbox(spark, sf_dir)
    target = seeded_target(spark, sf_dir)
    scan = S.scan_lines(S.read_lines(spark, inbox), columns=S.REQUIRED_COLUMNS, keep=keep_validated())
    return file_warnings(scan_outcome(scan, lambda keys: snapshot_keys(spark, target, keys), 1000).rejections())


@register(
    "report_files",
    _STREAM + f", rej AS ({_REPORTED_ORDER}) SELECT file_seq, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) AS BIGINT) AS written FROM rej GROUP BY file_seq",
)
def report_files(spark, sf_dir):
    """B3 for several files: the report's manifest names each file's folder; the lines that it has (without header)."""
    from tollgate.sinks.csv_text import report_manifest

    inbox, _ = make_inbox(spark, sf_dir)
    res = import_csv(spark, inbox, seeded_target(spark, sf_dir), 1000, report_dir=scratch_path(spark, "reports"), run_ts=RUN_TS)
    if res.error_report_path is None:
        return spark.createDataFrame([], "file_seq int, lines bigint, written bigint")
    lines = spark.read.text(res.error_report_path)
    if "file" not in lines.columns:  # a single file's report has no folders
        n = lines.count() - 1
        return spark.createDataFrame([(0, n, n)], "file_seq int, lines bigint, written bigint")
    manifest = report_manifest(spark, res.error_report_path).select(_file_seq(F.col("file_path")).alias("file_seq"), "file", "lines")
    written = lines.groupBy("file").agg((F.count("*") - 1).cast("bigint").alias("written"))
    return manifest.join(written, "file").select("file_seq", "lines", "written")
