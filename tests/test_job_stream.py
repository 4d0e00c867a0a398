"""The streamed job ledger equals the batch replay, however the log is cut; retention by timers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import jobs as JB
from tollgate.streaming.job_stream import followed_status, follow_jobs

SCHEMA = "job_id long, ts timestamp_ntz, event_id long, kind string, report_error string, reason string"


def make_log(seed, n):
    rng = random.Random(seed)
    log, at = [], dt.datetime(2026, 1, 1)
    for i in range(n):
        at += dt.timedelta(seconds=rng.randint(0, 3))
        kind = rng.choice([JB.CREATE, JB.START, JB.COMPLETE, JB.FAIL, "other"])
        job = 1 if rng.random() < 0.3 else rng.randint(2, 30)
        log.append((job, at, i, kind, "broken" if kind == JB.COMPLETE and rng.random() < 0.3 else None, f"r{i}" if kind == JB.FAIL else None))
    return log


def follow(spark, tmp_path, log, cuts, **kw):
    src, out = str(tmp_path / "log"), str(tmp_path / "verdicts")
    bounds = sorted({0, len(log), *cuts})
    for a, b in zip(bounds, bounds[1:]):  # a file per piece, written one after the other
        part = log[a:b]
        random.Random(a).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        follow_jobs(stream, out, str(tmp_path / "ck"), **kw)  # each call goes on from the checkpoint
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed,cuts", [(1, []), (2, [10, 11, 60, 150])])
def test_any_cut_of_the_log(spark, tmp_path, seed, cuts):
    log = make_log(seed, 200)
    got = follow(spark, tmp_path, log, cuts).where("kind <> 'other'")
    replayed = JB.replay(spark.createDataFrame(log, SCHEMA))
    cols = ["event_id", "job_id", "kind", "state_before", "legal", "message"]
    want = replayed.where("kind <> 'other'").select(*cols)
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))
    status = followed_status(spark.read.parquet(str(tmp_path / "verdicts")))
    of_batch = JB.job_status(replayed).where(F.col("status").isNotNull()).select(*status.columns)
    assert sorted(map(str, status.collect())) == sorted(map(str, of_batch.collect()))


def test_finished_jobs_are_forgotten_after_a_while(spark, tmp_path):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    log = [(1, t(0), 1, JB.CREATE, None, None), (1, t(1), 2, JB.START, None, None), (1, t(2), 3, JB.COMPLETE, None, None),
           (2, t(3), 4, JB.CREATE, None, None), (1, t(5), 5, JB.START, None, None), (2, t(500), 6, JB.START, None, None),
           (1, t(501), 7, JB.START, None, None), (1, t(502), 8, JB.CREATE, None, None)]
    got = {r.event_id: r for r in follow(spark, tmp_path, log, [5, 6], keep_finished=60).collect()}
    assert got[5].message == 'Import job 1 cannot move from "completed" to "processing"'
    assert got[7].message == "Import job 1 was not found" and got[8].state_after == JB.PENDING
    assert got[6].legal and got[6].state_before == JB.PENDING  # unfinished jobs stay
