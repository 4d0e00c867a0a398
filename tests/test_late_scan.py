"""The late-numbered scan: quotes over splits, one read of the text, steps, progress, keyed target, id clock."""

import csv
import datetime as dt
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import skew
from tollgate.plans import pipeline as P
from tollgate.plans.pipeline import import_csv
from tollgate.sinks import table as TB
from tollgate.sinks.csv_text import report_manifest
from tollgate.sources import csv_scan as S

TS = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
HEADER = "name,email,enrollment_date,course_id,score"


def split_sizes(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", str(min(size, 64)))


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {n: spark.conf.get(n) for n in names}
    yield lambda size: split_sizes(spark, size)
    for n, v in old.items():
        spark.conf.set(n, v)


def random_csv(rng, rows, quoted, newline="\n"):
    """Text of a file, and its records as Python's csv reader has them (record number, cells)."""
    out = [HEADER]
    for i in range(rows):
        name = rng.choice(["Iris Holm", '"Holm, Iris"', '"a ""b"" c"', "", " "])
        if quoted and rng.random() < 0.15:
            name = '"' + newline.join(rng.choice(["x", "", "y,z", '""', "long " * 40]) for _ in range(rng.randint(2, 9))) + '"'
        out.append(rng.choice([f"{name},p{i}@tal.ch,2023-05-06,b,{i % 90}", f"{name},p{i}@tal.ch", "", f"{name},p{i}@tal.ch,,,,extra"]))
    text = newline.join(out) + newline
    records = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    return text, {n + 1: r for n, r in enumerate(records) if n and any(c.strip() for c in r)}


@pytest.mark.parametrize("size", [60, 301, 1 << 20])
def test_records_over_splits_of_any_size(spark, tmp_path, small_splits, size):
    """Some files with quoted line feeds, some without; records that cross one split and many."""
    rng = random.Random(size)
    want = {}
    for k in range(3):
        text, records = random_csv(rng, 60, quoted=k != 1, newline="\r\n" if k == 2 else "\n")
        path = tmp_path / f"f {k}.csv"
        path.write_bytes(text.encode())
        want |= {(k, n): (r[0] or None, (r + [""] * 5)[1] or None) for n, r in records.items()}
    small_splits(size)
    got = S.scan_csv(spark, str(tmp_path)).collect()
    assert {(r["file_seq"], r["line_number"]): (r["name"], r["email"]) for r in got} == want


def test_more_files_than_are_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(S, "MAX_BROADCAST_FILES", 1)
    rng = random.Random(1)
    want = {}
    for k in range(4):
        text, records = random_csv(rng, 40, quoted=False)
        (tmp_path / f"{k}.csv").write_text(text)
        want |= {(k, n): (r[0] or None, (r + [""] * 5)[1] or None) for n, r in records.items()}
    small_splits(400)
    got = S.scan_csv(spark, str(tmp_path)).collect()
    assert {(r["file_seq"], r["line_number"]): (r["name"], r["email"]) for r in got} == want


def test_the_text_is_read_once_and_not_shuffled(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(HEADER + "\n" + "".join(f"Iris Holm,p{i}@tal.ch,2023-05-06,b,5\n" for i in range(2000)) + "A,x,y,z,w\n")
    scan = S.scan_lines(S.read_lines(spark, str(p)), columns=S.REQUIRED_COLUMNS, keep=P.keep_validated())
    # of the adaptive plan the part that was run
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    cache = plan(scan.cached[0])
    cache = cache[cache.index("InMemoryRelation"):]
    assert cache.count("FileScan text") == 1
    # what is shuffled is the header's cells, a few rows a file; the lines aren't
    assert all("header" in line or "_missing" in line or "file_seq" in line and "at#" not in line for line in cache.splitlines() if "Exchange hash" in line)
    assert "SortMergeJoin" not in cache and "Exchange rangepartitioning" not in cache
    out = P.scan_outcome(scan, lambda keys: keys.where(F.lit(False)), 1000)
    for frame in (out.rejections(), out.accepted()):  # all from the cache
        assert "InMemoryTableScan" in plan(frame)
    out.release()
    scan.release()


def sequential(files, registered, batch):
    """The reference's loop over (path, rows): per file flushes of ``batch`` valid rows."""
    stored, order, errors = set(registered), [], []
    for path, rows in files:
        pending, late = [], []

        def flush():
            seen = set()
            for line, email in pending:
                if email in stored:
                    late.append((path, line, "email", "A student with this email is already registered"))
                elif email in seen:
                    late.append((path, line, "email", "Email appears more than once in the file"))
                else:
                    seen.add(email)
                    order.append(email)
            stored.update(seen)
            errors.extend(now + late)
            pending.clear(), late.clear(), now.clear()

        now = []
        for line, email, ok in rows:
            if ok:
                pending.append((line, email))
                if len(pending) >= batch:
                    flush()
            else:
                now.append((path, line, "name", "Name must be at least 2 characters"))
        flush()
    return order, errors


def make_files(tmp_path, seed, n_files=3, rows=70, keys=40):
    rng, files = random.Random(seed), []
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(n_files):
        lines, facts = [HEADER], []
        for i in range(rows):
            if rng.random() < 0.1:
                lines.append("")
                continue
            email = f"p{0 if rng.random() < 0.3 else rng.randint(0, keys)}x{rng.randint(0, 4)}@tal.ch"
            ok = rng.random() > 0.15
            lines.append(f"{'Iris Holm' if ok else 'Q'},{email},2023-05-06,b,5")
            facts.append((len(lines), email, ok))
        (inbox / f"f{k}.csv").write_text("\n".join(lines) + "\n")
        files.append((f"f{k}.csv", facts))
    return str(inbox), files


def stored(spark, target):
    return [r["email"] for r in TB.read_target(spark, target).orderBy("id").collect()]


@pytest.mark.parametrize("seed,hot_rows", [(1, skew.HOT_ROWS), (2, 15)])
def test_import_equals_the_loop(spark, tmp_path, small_splits, monkeypatch, seed, hot_rows):
    """Batches, duplicate reasons, order of ids, samples and reports per file; one key holds a third of the rows."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    inbox, files = make_files(tmp_path, seed)
    small_splits(500)
    target = str(tmp_path / "t")
    res = import_csv(spark, inbox, target, 9, report_dir=str(tmp_path / "rep"), run_ts=TS)
    order, errors = sequential(files, set(), 9)
    assert stored(spark, target) == order
    assert (res.total_processed, res.total_imported, res.total_errors) == (sum(len(r) for _, r in files), len(order), len(errors))
    got = [(p.rsplit("/", 1)[-1], e["line_number"], e["field"], e["message"]) for p in sorted(res.file_errors) for e in res.file_errors[p]]
    assert got == [(p, n, f, m) for p, n, f, m in errors]
    manifest = {r["file"]: (r["file_path"].rsplit("/", 1)[-1], r["lines"]) for r in report_manifest(spark, res.error_report_path).collect()}
    assert manifest == {k: (p, sum(e[0] == p for e in errors)) for k, (p, _) in enumerate(files)}
    for k, (p, _) in enumerate(files):
        lines = [r[0] for r in spark.read.text(f"{res.error_report_path}/file={k}").collect()]
        assert lines[0] == "line_number,field,value,error_message"
        assert [int(x.split(",")[0]) for x in lines[1:]] == [e[1] for e in errors if e[0] == p]


@pytest.mark.parametrize("stop_after", [0, 25, 10_000])
def test_stop_inside_a_file_and_go_on(spark, tmp_path, small_splits, stop_after):
    inbox, files = make_files(tmp_path, 3)
    order, errors = sequential(files, set(), 5)
    target, progress = str(tmp_path / "t"), str(tmp_path / "p")
    kw = dict(batch_size=5, run_ts=TS, progress=progress, step_rows=10)
    first = import_csv(spark, inbox, target, should_stop=lambda rows: rows >= stop_after, **kw)
    assert first.aborted == (stop_after < 10_000)
    n = first.total_imported
    assert stored(spark, target) == order[:n] and (n == 0) == (stop_after == 0)
    if first.aborted and stop_after:
        assert first.total_processed >= stop_after and n < len(order)
    small_splits(333)  # the same lines, split otherwise
    rest = import_csv(spark, inbox, target, **kw)
    assert not rest.aborted and n + rest.total_imported == len(order)
    assert first.total_processed + rest.total_processed == sum(len(r) for _, r in files)
    assert first.total_errors + rest.total_errors == len(errors)
    assert stored(spark, target) == order
    again = import_csv(spark, inbox, target, **kw)
    assert (again.total_processed, again.total_imported) == (0, 0)


def test_a_step_that_died_after_its_append(spark, tmp_path, monkeypatch):
    inbox, files = make_files(tmp_path, 4)
    order, _ = sequential(files, set(), 5)
    target, kw = str(tmp_path / "t"), dict(batch_size=5, run_ts=TS, progress=str(tmp_path / "p"), step_rows=20)
    real, calls = P.Progress.add, []

    def dies(self, **entry):
        calls.append(entry["state"])
        if calls.count("done") == 2:
            raise RuntimeError("died")
        real(self, **entry)

    monkeypatch.setattr(P.Progress, "add", dies)
    with pytest.raises(RuntimeError):
        import_csv(spark, inbox, target, **kw)
    monkeypatch.setattr(P.Progress, "add", real)
    before = len(stored(spark, target))
    rest = import_csv(spark, inbox, target, **kw)
    assert sorted(stored(spark, target)) == sorted(order) and len(order) > before
    done = [e for e in P.Progress(spark, kw["progress"]).entries if e["state"] == "done"]
    assert done[-1]["imported"] == len(order) and done[-1]["processed"] == sum(len(r) for _, r in files)
    assert rest.total_imported == len(order) - done[0]["imported"]


def test_look_up_reads_the_buckets_of_its_keys(spark, tmp_path):
    target = str(tmp_path / "t")
    TB.create_target(spark, target, buckets=8)
    rows = spark.range(400).select(F.col("id").alias("line_number"), F.lit("Iris Holm").alias("name"), F.concat(F.lit("p"), "id", F.lit("@tal.ch")).alias("email"),
                                   F.lit("2023-05-06").alias("enrollment_date"), F.lit("b").alias("course_id"), F.lit("5").alias("score"))
    assert TB.append_new(rows, target, TS).inserted == 400
    one = spark.createDataFrame([("p7@tal.ch",), ("nobody@tal.ch",), (None,)], "email string")
    wanted = TB.wanted_buckets(one, 8)
    keys = TB.registered_keys(spark, target, wanted)
    assert "PartitionFilters: [" in keys._jdf.queryExecution().toString() and len({f.split("key_bucket=")[1][0] for f in keys.inputFiles()} ) >= 1
    files = keys.select("email", F.col("_metadata.file_path").alias("f")).select("f").distinct().count()
    assert files <= 2 * len(wanted) < TB.read_target(spark, target).select("_metadata.file_path").distinct().count()
    assert [r["email"] for r in TB.snapshot_keys(spark, target, one).collect()] == ["p7@tal.ch"]
    assert TB.registered_keys(spark, target, []).collect() == []
    assert TB.append_new(rows, target, TS).skipped == 400


def test_rows_that_come_after_the_look_up_are_skipped(spark, tmp_path):
    from tollgate.session import list_files

    target = str(tmp_path / "t")
    TB.create_target(spark, target)
    cols = "line_number long, name string, email string, enrollment_date string, course_id string, score string"
    row = lambda n: (n, "Iris Holm", f"p{n}@tal.ch", "2023-05-06", "b", "1")
    seen = set(list_files(spark, target))
    TB.append_new(spark.createDataFrame([row(1)], cols), target, TS)
    res = TB.append_new(spark.createDataFrame([row(1), row(2)], cols), target, TS, seen=seen)
    assert (res.offered, res.inserted, res.skipped) == (2, 1, 1)
    assert TB.constraint_audit(TB.read_target(spark, target)).collect() == []


def test_runs_of_one_time_share_no_millisecond(spark, tmp_path):
    target, ms = str(tmp_path / "t"), int(TS.timestamp() * 1000)
    TB.create_target(spark, target)
    taken = [TB.reserve_millis(spark, target, ms, n) for n in (1, 3, 2, 1)]
    assert taken == [ms, ms + 1, ms + 4, ms + 6]
    assert TB.reserve_millis(spark, target, ms + 100) == ms + 100 and TB.reserve_millis(spark, target, ms) == ms + 101


def test_ids_beyond_two_to_the_40_rows(spark):
    from tollgate.functions.ids import millis_needed, uuid7_millis

    rows = [(n, "Iris Holm", f"p{n}@tal.ch", "2023-05-06", "b", "1") for n in (5, (1 << 40) - 1, 1 << 40, (3 << 40) + 2)]
    df = spark.createDataFrame(rows, "line_number long, name string, email string, enrollment_date string, course_id string, score string")
    ids = [r["id"] for r in TB.to_stored(df, TS).collect()]
    assert ids == sorted(ids) and len(set(ids)) == 4
    ms = [r[0] for r in TB.to_stored(df, TS).select(uuid7_millis(F.col("id"))).collect()]
    assert [m - ms[0] for m in ms] == [0, 0, 1, 3] and millis_needed((3 << 40) + 2) == 4


def test_names_with_blanks_and_marks(spark, tmp_path):
    folder = tmp_path / "in [1]"
    folder.mkdir()
    (folder / "a b%20{x}.csv").write_text(HEADER + '\n"Iris\nHolm",i@tal.ch,2023-05-06,b,5\n')
    os.symlink(folder, tmp_path / "plain")
    rows = S.scan_csv(spark, str(tmp_path / "plain")).collect()
    assert [(r["line_number"], r["name"]) for r in rows] == [(2, "Iris\nHolm")]


def test_bytes_that_are_no_utf8(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes(HEADER.encode() + b'\nIr\xefs Holm,i@tal.ch,2023-05-06,b,5\n"two\nlines \xe9",j@tal.ch,2023-05-06,b,5\n')
    assert [r["line_number"] for r in S.scan_csv(spark, str(p)).orderBy("line_number").collect()] == [2, 3]


def test_no_rows(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text(HEADER + "\n")
    res = import_csv(spark, str(p), str(tmp_path / "t"), run_ts=TS)
    assert (res.total_processed, res.total_imported, res.errors, res.error_report_path) == (0, 0, [], None)
    (tmp_path / "e.csv").write_text("")
    res = import_csv(spark, str(tmp_path / "e.csv"), str(tmp_path / "t"), run_ts=TS)
    assert (res.total_processed, res.total_imported) == (0, 0)


def test_steps_are_written_at_once_and_moved(spark, tmp_path, monkeypatch):
    """One write for all steps; keys that another writer stores between two steps are left out of the later ones."""
    inbox, files = make_files(tmp_path, 3)
    order, _ = sequential(files, set(), 5)
    target, writes = str(tmp_path / "t"), []
    real, publish = TB.stage_steps, TB.publish_step
    monkeypatch.setattr(TB, "stage_steps", lambda *a: writes.append(a) or real(*a))
    monkeypatch.setattr(P.StagedSteps, "LIST_SECONDS", 0.0)
    rival = order[-1]

    def meanwhile(spark, path, step, *rest):
        moved = publish(spark, path, step, *rest)
        if step == 0:
            row = spark.createDataFrame([(1, "Iris Holm", rival, "2023-05-06", "b", "5")],
                                        "line_number bigint, name string, email string, enrollment_date string, course_id string, score string")
            TB.store(TB.to_stored(row, TS - dt.timedelta(days=1)), path)
        return moved

    monkeypatch.setattr(TB, "publish_step", meanwhile)
    res = import_csv(spark, inbox, target, batch_size=5, run_ts=TS, step_rows=10)
    assert len(writes) == 2  # at the beginning and after the rival
    assert res.total_imported == len(order) - 1 and res.total_processed == sum(len(r) for _, r in files)
    assert sorted(stored(spark, target)) == sorted(order)


def test_lines_of_documents_count_on_through_files(spark, tmp_path, monkeypatch):
    """The row size guard over several files of few documents numbers lines as over one."""
    from tollgate.plans import catalogue_io as C

    monkeypatch.setattr(C, "DOCUMENTS_PER_FILE", 4)
    long = {3, 4, 7, 10}
    rows = [(i, "x" * (C.GUARD_LIMIT + i) if i in long else 'a "b"\nc' if i % 2 else "") for i in range(11)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["line_number"], r["record_bytes"]) for r in C.csv_row_size_guard(spark, str(tmp_path)).collect()}
    assert got == {(i + 2, C.GUARD_LIMIT + i + len(f"{i},")) for i in long}


def test_first_lines_of_small_files_need_no_python_task(spark, tmp_path, monkeypatch):
    from tollgate.sources import csv_scan as S

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_bytes(b"\xef\xbb\xbf\"name\",email\nx,y\n")
    (inbox / "b.csv").write_bytes(b"email,name\r\n" + b"p,q\r\n" * 40)
    (inbox / "c.csv").write_bytes(b"")

    def firsts():
        rows = S.first_lines(spark, str(inbox), S.read_lines(spark, str(inbox))).collect()
        return sorted((r["file_path"][-5:], r["text"], r["file_size"], r["quoted"]) for r in rows)

    python = []
    monkeypatch.setattr(S, "scratch_path", lambda s, n, k=iter(range(9)): str(tmp_path / f"{n}-{next(k)}"))
    cls = type(spark.range(1))
    mapped = cls.mapInArrow
    monkeypatch.setattr(cls, "mapInArrow", lambda df, *a, **kw: python.append(df.count()) or mapped(df, *a, **kw))
    expected = [("a.csv", '"name",email', 20, True), ("b.csv", "email,name\r", 212, False)]
    assert firsts() == expected
    assert python == [0]  # no line reached a Python task
    monkeypatch.setattr(S, "SMALL_FILE", 100)  # b.csv is a large one now
    assert firsts() == expected
    assert python == [0, 41]


def test_parsed_rows_are_cached_with_compiled_methods(spark, tmp_path, monkeypatch):
    from tollgate.plans.pipeline import keep_validated
    from tollgate.sources import csv_scan as S

    path = tmp_path / "a.csv"
    path.write_text("name,email,enrollment_date,course_id,score\nNia,n@x.org,2024-01-01,C1,5\n")
    cls, seen = type(spark.range(1)), []
    kept = cls.persist
    monkeypatch.setattr(cls, "persist", lambda df, *a: seen.append(
        ("violations" in df.columns, spark.conf.get("spark.sql.codegen.hugeMethodLimit"))) or kept(df, *a))
    scan = S.scan_lines(S.read_lines(spark, str(path)), columns=S.REQUIRED_COLUMNS, keep=keep_validated())
    scan.release()
    assert [limit for rules, limit in seen if rules] == ["8000"]


def test_audit_rules_are_not_copied_into_a_filter(spark):
    import datetime as dt
    from decimal import Decimal

    from tollgate.sinks import table as TB

    at = dt.datetime(2026, 1, 1)
    rows = [("1", "Nia", "n@x.org", dt.date(2024, 1, 1), "C1", Decimal("5.00"), at), ("2", "M4", "bad", dt.date(2024, 1, 1), "C1", Decimal("5.00"), at)]
    audit = TB.readback_audit(spark.createDataFrame(rows, TB.STUDENTS_SCHEMA).repartition(2))
    assert [tuple(r) for r in audit.collect()] == [
        ("2", "Corrupted student row 2: name: Name may only contain letters, spaces, hyphens and apostrophes; email: Email must be a valid address")]
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]


def test_a_small_micro_batch_is_planned_without_shuffles(spark, tmp_path, monkeypatch):
    """Few lines in one partition have the outcome that they have otherwise, by plans of a single stage."""
    from pyspark.sql import DataFrame

    inbox, _ = make_files(tmp_path, 6)
    known = spark.createDataFrame([("p1x1@tal.ch",), ("p0x2@tal.ch",)], "email string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]

    def facts(few: bool):
        lines = S.read_lines(spark, inbox).select("*")  # as a micro-batch: not known to be of these paths
        scan = S.scan_lines(lines, S.REQUIRED_COLUMNS, check_header=False, check_size=False, columns=S.REQUIRED_COLUMNS, keep=P.keep_validated())
        assert (scan.few, scan.placed) == (few, few)
        with S.settings(spark, scan.settings):
            scan = scan.without([1])
            out = P.scan_outcome(scan, lambda keys: keys.join(F.broadcast(known), "email", "left_semi").distinct(), 7)
            ends = out.boundaries(14)
            line = {p: n for p, n in ends}
            mark = ends[1][0]
            rows = lambda df: sorted(map(str, df.collect()))
            frames: list[DataFrame] = [out.rejections(), out.accepted(), out.accepted(steps=(14, ends))]
            if few:
                assert not [f for f in frames if "Exchange hash" in plan(f) or "Exchange range" in plan(f)]
            got = [rows(f) for f in frames] + [rows(out.accepted(None, mark).select("email")), out.counts(), out.counts(None, mark),
                   out.counts(mark, None), sorted(line.values()), out.step_counts(14, ends), [f[1:] for f in scan.listing]]
        out.release()
        scan.release()
        return got

    small = facts(True)
    monkeypatch.setattr(S, "SHUFFLE_BYTES", 1)
    assert small == facts(False)


def test_the_samples_of_files_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """100 violations reach the driver, however many files there are; a file's when they are asked for."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    for k in range(3):
        (inbox / f"f{k}.csv").write_text(HEADER + "\n" + "".join(f"Q,p{k}x{i}@tal.ch,2023-05-06,b,5\n" for i in range(60 + 50 * k)))
    cls, got = type(spark.range(1)), []
    collect = cls.collect
    monkeypatch.setattr(cls, "collect", lambda df: got.append(rows := collect(df)) or rows)
    res = import_csv(spark, str(inbox), str(tmp_path / "t"), run_ts=TS)
    assert max(map(len, got)) == 100 and sum(len(r) > 10 for r in got) == 1
    assert [(e["file_seq"], e["line_number"]) for e in res.errors] == [(0, n) for n in range(2, 62)] + [(1, n) for n in range(2, 42)]
    by_file = [[e["line_number"] for e in res.file_errors[p]] for p in sorted(res.file_errors)]
    assert by_file == [list(range(2, 62)), list(range(2, 102)), list(range(2, 102))] and len(res.file_errors) == 3
    with pytest.raises(KeyError):
        res.file_errors["no such file"]


def test_steps_are_published_in_groups(spark, tmp_path, monkeypatch):
    """Many steps, few entries and moves; a stop inside a group stores its first steps; a run that stops soon has written little ahead."""
    inbox, files = make_files(tmp_path, 3, n_files=2)
    order, _ = sequential(files, set(), 5)
    assert P.step_groups(3, 20, 10) == [(3, 4), (4, 6), (6, 10), (10, 18), (18, 20)]
    assert P.step_groups(0, 3, 10 ** 6) == [(0, 1), (1, 2), (2, 3)]
    kw, written, real = dict(batch_size=5, run_ts=TS, step_rows=5), [], TB.stage_steps
    monkeypatch.setattr(TB, "stage_steps", lambda rows, *a: written.append(rows.count()) or real(rows, *a))
    done = lambda p: [e for e in P.Progress(spark, p).entries if e["state"] == "done"]
    import_csv(spark, inbox, str(tmp_path / "t"), progress=str(tmp_path / "p"), **kw)
    steps = sum(sum(ok for *_, ok in f) // 5 for _, f in files) + 1
    assert steps > 20 and len(done(str(tmp_path / "p"))) == len(P.step_groups(0, steps, 5)) <= 6 and written == [len(order)]
    monkeypatch.setattr(P.StagedSteps, "AHEAD", 1)
    written.clear()
    target, progress = str(tmp_path / "t2"), str(tmp_path / "p2")
    first = import_csv(spark, inbox, target, progress=progress, should_stop=lambda rows: rows >= 30, **kw)  # within (3, 7)
    assert first.aborted and 30 <= first.total_processed < 40 and sum(written) < len(order)
    assert stored(spark, target) == order[: first.total_imported] and done(progress)[-1]["processed"] == first.total_processed
    rest = import_csv(spark, inbox, target, progress=progress, **kw)
    assert first.total_imported + rest.total_imported == len(order) and sorted(stored(spark, target)) == sorted(order)
    assert stored(spark, target) == order
