"""Benchmark the headline plans; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Timing: one warm-up pass on sf0.001 (JIT, generated-code cache), then two timed passes;
each query reports the faster of the two.

Queries (rows = orders rows, 150,000 at sf0.1):
  validate        parse + validate every row, count valid / invalid (baseline: 5.66 s streaming parse+validate of 500k rows)
  import_outcome  validate + batch numbers + first-wins + registered check, summary counters
  report_write    ordered error report written as text parts
  csv_import      full import of a CSV file: scan, validate, dedup, report, append to Parquet
  stream_import   the same rows as an inbox of files, one micro-batch into a Parquet target
  job_status      job ledger replay over events, asked for every customer key
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tollgate.plans import catalogue_jobs  # noqa: E402
from tollgate.plans.catalogue_io import students_csv  # noqa: E402
from tollgate.plans.catalogue_store import RUN_TS, seeded_target  # noqa: E402
from tollgate.plans.catalogue_stream import make_inbox  # noqa: E402
from tollgate.plans.pipeline import import_csv, outcome, release  # noqa: E402
from tollgate.operators.report import rejections  # noqa: E402
from tollgate.operators.summary import import_summary, valid_invalid_count  # noqa: E402
from tollgate.plans.spec import STUDENTS, validate  # noqa: E402
from tollgate.session import get_spark, scratch_path  # noqa: E402
from tollgate.sinks.csv_text import write_report  # noqa: E402
from tollgate.sources.fixtures import raw_students, registered  # noqa: E402
from tollgate.streaming.stream import stream_import  # noqa: E402


def timed(fn):
    t0 = time.perf_counter()
    out = fn()
    return time.perf_counter() - t0, out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    n_rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()

    def run_all(d: str):
        return run_queries(spark, d)

    # warm-up on the smallest tables: JVM JIT and the generated-code cache see every plan once,
    # so the timed pass measures steady-state throughput rather than one-off compilation
    run_all(os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    # two timed passes; per query the faster one (this host's timings vary by tens of percent)
    q1, res = run_all(sf_dir)
    q2, _ = run_all(sf_dir)
    q = {k: min(q1[k], q2[k]) for k in q1}
    gen = generated_comparison(spark)
    total = sum(q.values())
    print(json.dumps({
        "metric": "headline_total",
        "value": round(total, 3),
        "unit": "sec",
        "timing": "best of 2 passes after a warm-up pass on sf0.001",
        "queries": {k: round(v, 3) for k, v in q.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "rows": n_rows,
        "rows_per_sec": {
            "validate": round(n_rows / q["validate"]),
            "import_outcome": round(n_rows / q["import_outcome"]),
            "csv_import": round(res.total_processed / q["csv_import"]),
        },
        "csv_import_result": {"processed": res.total_processed, "imported": res.total_imported,
                              "rejected": res.total_errors},
        "generated_500k": gen,
    }))
    spark.stop()


GENERATED_ROWS = 500_000  # the reference's published benchmark file size


def generated_comparison(spark) -> dict:
    """Same shape as the reference's headline numbers: a 500,000-row generated CSV (~5 % corrupted).

    Parse + validate (no uniqueness, no database) and the full import into a Parquet target.
    The CSV is written once (not timed); the code paths are warm from the passes above.
    """
    from tollgate.sinks.csv_text import write_csv_files
    from tollgate.plans.pipeline import keep_validated
    from tollgate.sources.csv_scan import REQUIRED_COLUMNS, read_lines, scan_lines
    from tollgate.sources.generate import generate_students

    cols = ["name", "email", "enrollment_date", "course_id", "score"]
    rows = generate_students(spark.range(GENERATED_ROWS).withColumnRenamed("id", "idx"), "idx", seed=42, error_rate=0.05)
    path = scratch_path(spark, "generated") + ".csv"
    write_csv_files(rows, path, cols, "row_index", rows_per_file=GENERATED_ROWS)

    def parse_validate():
        scan = scan_lines(read_lines(spark, path), REQUIRED_COLUMNS, columns=REQUIRED_COLUMNS, keep=keep_validated())
        rows, valid = scan.splits.agg(F.sum("data"), F.sum("valid")).first()
        scan.release()
        return {"valid_rows": valid, "invalid_rows": rows - valid}

    t_pv, counts = timed(parse_validate)
    target = scratch_path(spark, "generated-target")
    t_imp, res = timed(lambda: import_csv(spark, path, target, 1000, report_dir=scratch_path(spark, "gen-rep"),
                                          run_ts=RUN_TS))
    return {
        "rows": GENERATED_ROWS,
        "parse_validate_sec": round(t_pv, 3),
        "parse_validate_rows_per_sec": round(GENERATED_ROWS / t_pv),
        "valid": counts["valid_rows"], "invalid": counts["invalid_rows"],
        "full_import_sec": round(t_imp, 3),
        "full_import_rows_per_sec": round(GENERATED_ROWS / t_imp),
        "imported": res.total_imported, "rejected": res.total_errors,
        "reference": {"parse_validate_sec": 5.66, "full_import_sec": 59.0},
    }


def run_queries(spark, sf_dir: str):
    q = {}
    q["validate"], _ = timed(lambda: valid_invalid_count(validate(raw_students(spark, sf_dir), STUDENTS)).collect())
    def summary():
        out = outcome(raw_students(spark, sf_dir), registered(spark, sf_dir))
        rows = import_summary(out).collect()
        release(out)
        return rows

    q["import_outcome"], _ = timed(summary)

    def report():
        out = outcome(raw_students(spark, sf_dir), registered(spark, sf_dir))
        path = write_report(rejections(out), scratch_path(spark, "bench-reports"), RUN_TS)
        release(out)
        return path

    q["report_write"], _ = timed(report)

    csv_path = students_csv(spark, sf_dir)
    target = seeded_target(spark, sf_dir)
    q["csv_import"], res = timed(lambda: import_csv(spark, csv_path, target, 1000, report_dir=scratch_path(spark, "bench-rep"),
                                                    run_ts=RUN_TS))
    inbox, _ = make_inbox(spark, sf_dir)  # not timed
    where = (inbox, seeded_target(spark, sf_dir), scratch_path(spark, "bench-ckpt"), scratch_path(spark, "bench-ledger"))
    q["stream_import"], _ = timed(lambda: stream_import(spark, *where, run_ts=RUN_TS))
    q["job_status"], _ = timed(lambda: catalogue_jobs.job_status(spark, sf_dir).where(F.col("status").isNotNull()).count())
    return q, res


if __name__ == "__main__":
    main()
