"""The import plan: raw rows -> rules -> batch numbers -> first-wins -> outcome.

``outcome(raw, registered)`` is lazy.  ``import_rows`` runs it once, persisted,
and derives the three products from that one frame (append, report, summary),
so all of them see the same numbering and the same generated ids.
"""

from __future__ import annotations

import itertools
import json
import time
from dataclasses import dataclass, replace
from typing import Callable, Iterator, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.ids import millis_needed, uuid7_millis
from tollgate.functions.rules import CODES, MSG
from tollgate.operators import skew
from tollgate.operators.report import MAX_ERRORS_IN_RESULT, error_sample, file_samples, order_key, rejections
from tollgate.operators.skew import hot_keys, hot_split_join
from tollgate.operators.summary import import_summary
from tollgate.operators.unique import assign_batches, classify
from tollgate.plans.spec import STUDENTS, DataSpec, explode_violations, validate
from tollgate.session import create_exclusive, list_files, names_in, path_exists, read_small, remove_path, scratch_path
from tollgate.sources.csv_scan import COMPILED_METHODS, MAX_BROADCAST_FILES, REQUIRED_COLUMNS, CsvScan, local_rows, read_lines, scan_lines, settings

DEFAULT_BATCH_SIZE = 1000


def outcome(
    raw: DataFrame,
    registered: DataFrame,
    batch_size: int = DEFAULT_BATCH_SIZE,
    spec: DataSpec = STUDENTS,
    partition_cols: Sequence[str] = (),
    row_bound: int | None = None,
) -> DataFrame:
    """Every raw row with ``violations``, normalised values, ``batch_no`` and ``status``.

    The batched frame feeds four branches (valid / invalid split, per-key
    aggregate, join back), so it is persisted once (memory, spilling to disk;
    lost blocks are recomputed from lineage).  ``release(out)`` frees it.
    """
    # the rule intermediates (normalised text, lengths, first messages) are folded into
    # ``violations`` / ``is_valid`` / ``<f>_value``: drop them before the rows are shuffled and
    # cached (neither an exchange under a cache nor the cache itself prunes columns)
    validated = validate(raw, spec).drop(
        *[f"{f.name}_{part}" for f in spec.fields for part in ("norm", "len", "error")])
    # line numbers never exceed the lines read, so a known row bound also bounds the order column
    with settings(raw.sparkSession, COMPILED_METHODS):  # a cached plan keeps the settings that it was persisted with
        batched = assign_batches(validated, batch_size, partition_cols=partition_cols, max_order=row_bound)
        shuffled = getattr(batched, "_tollgate_cached", [])
        batched = batched.persist(StorageLevel.MEMORY_AND_DISK)
    out = classify(batched, registered, key_col=f"{spec.key}_value", partition_cols=partition_cols, row_bound=row_bound)
    out._tollgate_cached = [batched, *shuffled, *getattr(out, "_tollgate_cached", [])]  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Unpersist the intermediate frames an ``outcome`` plan holds."""
    for cached in getattr(df, "_tollgate_cached", []):
        cached.unpersist()


def accepted_rows(out: DataFrame, spec: DataSpec = STUDENTS) -> DataFrame:
    """Rows that will be stored, in the target's column order (without id / created_at)."""
    return out.where(F.col("status") == "unique").select(
        "line_number", *[F.col(f"{f.name}_value").alias(f.name) for f in spec.fields if f.name != "id"]
    )


@dataclass
class ImportRun:
    outcome: DataFrame
    rejections: DataFrame
    summary: DataFrame
    sample: DataFrame

    def release(self) -> None:
        self.outcome.unpersist()
        release(self.outcome)


def import_rows(
    raw: DataFrame,
    registered: DataFrame,
    batch_size: int = DEFAULT_BATCH_SIZE,
    spec: DataSpec = STUDENTS,
    partition_cols: Sequence[str] = (),
    row_bound: int | None = None,
) -> ImportRun:
    planned = outcome(raw, registered, batch_size, spec, partition_cols, row_bound)
    out = planned.persist(StorageLevel.MEMORY_AND_DISK)
    out._tollgate_cached = getattr(planned, "_tollgate_cached", [])  # type: ignore[attr-defined]
    rej = rejections(out, partition_cols)
    return ImportRun(out, rej, import_summary(out), error_sample(rej, partition_cols))


# ---- import of scanned files: one wide cache, numbers where rows leave ---------------------


def keep_validated(spec: DataSpec = STUDENTS):
    """What a scan keeps of its parsed rows: typed values, violations, validity."""
    values = [f"{f.name}_value" for f in spec.fields]
    return lambda rows: validate(rows, spec).select(
        "file_seq", "split", "at", "record_bytes", "quotes", "is_blank", "violations", "is_valid", *values)


PLACE = ("file_seq", "split", "at")  # where a row stands; comparable within an import


def after(mark: tuple | None) -> Column:
    """Rows behind a place (all, if there is none)."""
    return F.lit(True) if mark is None else F.struct(*PLACE) > F.struct(*[F.lit(v).cast(t) for v, t in zip(mark, ("int", "bigint", "bigint"))])


def up_to(mark: tuple | None) -> Column:
    return F.lit(True) if mark is None else ~after(mark)


@dataclass
class ScanOutcome:
    """The outcome of an import of scanned files.

    Only ``scan.rows`` is wide and cached, in input order and without a shuffle.  Everything else is
    narrow: ``firsts`` has a row per key, ``splits`` a row per split.  Line and batch numbers are
    bound to the rows that leave (``rejections``, ``accepted``) by a join with the splits: a row's
    number of valid rows before it is that of its split plus its number among the valid rows of the
    split or, for a row that isn't valid, its place less its number among those.
    """

    scan: CsvScan
    spec: DataSpec
    batch_size: int
    splits: DataFrame      # the scan's, with the first number of valid and of other rows
    firsts: DataFrame      # key, _n, first (place and number), registered: cached
    hot: list
    n_winners: int         # rows to be stored

    def _bound(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """Add line_number and batch_no to rows with their place and ``number`` among the valid rows."""
        s = self.splits.select("file_seq", "split", "first", "lines_before", "valid_before", "first_valid")
        names = {c: f"_{c}" for c in ("first", "lines_before", "valid_before", "first_valid")}
        bound = rows.join(s.withColumnsRenamed(names), ["file_seq", "split"])
        before = F.col("_valid_before") + F.col("number") - F.col("_first_valid")
        return bound.withColumn("line_number", (F.col("at") - F.col("_first") + F.col("_lines_before") + 1).cast("bigint")).withColumn(
            "batch_no", F.floor(before / F.lit(self.batch_size)).cast("bigint")).drop(*names.values())

    def invalid(self) -> DataFrame:
        """Rows that break a rule: place, line_number, batch_no, violations."""
        rows = split_rows(self.scan, self.spec)[1].where(~F.col("is_header") & ~F.col("is_blank"))
        s = self.splits.select("file_seq", "split", "first", "lines_before", "valid_before", "first_other")
        names = {c: f"_{c}" for c in ("first", "lines_before", "valid_before", "first_other")}
        inside = F.col("at") - F.col("_first")
        valid = F.col("_valid_before") + inside - (F.col("number") - F.col("_first_other"))
        return rows.join(s.withColumnsRenamed(names), ["file_seq", "split"]).select(
            *PLACE, (inside + F.col("_lines_before") + 1).cast("bigint").alias("line_number"),
            F.floor(valid / F.lit(self.batch_size)).cast("bigint").alias("batch_no"), "violations")

    def duplicates(self) -> DataFrame:
        """Valid rows whose key is registered or came before: place, line_number, batch_no, value, message."""
        valid, _ = split_rows(self.scan, self.spec)
        repeated = self.firsts.where((F.col("_n") > 1) | F.col("registered"))
        rows = hot_split_join(valid, repeated, "key", self.hot)
        rows = rows.where(F.col("registered") | (F.struct(*PLACE) != F.struct(*[F.col(f"first.{c}") for c in PLACE])))
        rows = self._bound(rows)
        where_first = rows.where(~F.col("registered")).select("key", F.col("first.file_seq").alias("file_seq"), F.col("first.split").alias("split"),
                                                              F.col("first.at").alias("at"), F.col("first.number").alias("number")).distinct()
        flush = self._bound(where_first).select("key", F.col("file_seq").alias("_file"), F.col("batch_no").alias("_flush"))
        joined = rows.join(flush, "key", "left")
        in_file = ~F.col("registered") & (F.col("file_seq") == F.col("_file")) & (F.col("batch_no") == F.col("_flush"))
        return joined.select(*PLACE, "line_number", "batch_no", F.col("key").alias("value"),
                             F.when(in_file, F.lit(MSG["dup_file"])).otherwise(F.lit(MSG["dup_existing"])).alias("message"))

    def rejections(self, start: tuple | None = None, end: tuple | None = None) -> DataFrame:
        """The violations of invalid rows and a row per duplicate, with the report's order, of a range of places."""
        keep, here = ["file_seq", "batch_no", "line_number"], after(start) & up_to(end)
        inv = explode_violations(self.invalid().where(here), keep).withColumn("is_duplicate", F.lit(0))
        ordinal = self.spec.field_names().index(self.spec.key) + 1
        dup = self.duplicates().where(here).select(
            *keep, F.lit(ordinal).alias("field_ordinal"), F.lit(self.spec.key).alias("field"), "value", "message",
            F.lit(CODES["duplicate"]).alias("code"), F.lit(1).alias("is_duplicate"))
        return inv.unionByName(dup)

    def _winners(self) -> DataFrame:
        return self.firsts.where(~F.col("registered"))

    def accepted(self, start: tuple | None = None, end: tuple | None = None, steps: tuple[int, list] | None = None) -> DataFrame:
        """Rows to be stored, of a range of places: ordinal (over all files) and the typed fields.

        Wide rows move once, to their keys; those of a hot key stay where they are.  With ``steps``
        (rows of a step, the steps' ends) also their ``step``.
        """
        here = F.struct(*[F.col(f"first.{c}").alias(c) for c in PLACE])
        w = self._winners().select("key", here.alias("_won"), *[F.col(f"first.{c}") for c in (*PLACE, "number")]).where(after(start) & up_to(end))
        extra = [] if steps is None else ["step"]
        w = w if steps is None else self._steps(w, *steps)
        w = self.scan.with_ordinal(self.scan.numbered(w)).select("key", "_won", "ordinal", *extra)
        rows = self.scan.data().where(F.col("is_valid") & after(start) & up_to(end)).withColumn("key", F.col(f"{self.spec.key}_value"))
        rows = hot_split_join(rows, w, "key", self.hot).where(F.struct(*PLACE) == F.col("_won"))
        return rows.select("file_seq", "ordinal", *extra, *[F.col(f"{f.name}_value").alias(f.name) for f in self.spec.fields])

    def _steps(self, rows: DataFrame, every: int, ends: list[tuple], valid_rows: bool = True) -> DataFrame:
        """Add ``step``, how many of the steps' ``ends`` lie before a row with its place and ``number``.

        A file's ends are its every ``every``-th valid row, so that number follows from the valid rows before.
        """
        first = "first_valid" if valid_rows else "first_other"
        s = self.splits.select("file_seq", "split", F.col("first").alias("_first"), F.col("valid_before").alias("_valid_before"), F.col(first).alias("_begin"))
        inside = F.col("number") - F.col("_begin")
        before = F.col("_valid_before") + (inside if valid_rows else F.col("at") - F.col("_first") - inside)
        return rows.join(s, ["file_seq", "split"]).join(self._earlier(ends), "file_seq").withColumn(
            "step", (F.col("_earlier") + F.floor(before / F.lit(every))).cast("bigint")).drop("_first", "_valid_before", "_begin", "_earlier")

    def _earlier(self, ends: list[tuple]) -> DataFrame:
        """file_seq and ``_earlier``, how many of the ``ends`` are in the files before."""
        in_file: dict[int, int] = {}
        for place, _ in ends:
            in_file[place[0]] = in_file.get(place[0], 0) + 1
        earlier = list(itertools.accumulate((in_file.get(k, 0) for k in range(self.scan.n_files)), initial=0))[: self.scan.n_files]
        earlier = local_rows(self.scan.rows.sparkSession, list(enumerate(earlier)), {"file_seq": "int32", "_earlier": "int64"})
        return F.broadcast(earlier) if self.scan.n_files <= MAX_BROADCAST_FILES else earlier

    def step_counts(self, every: int, ends: list[tuple], start: tuple | None = None) -> dict[int, tuple[int, int]]:
        """(rows processed, rows to be stored) of each step behind a place; a row per step reaches the driver."""
        valid, other = split_rows(self.scan, self.spec)
        other = other.where(~F.col("is_header") & ~F.col("is_blank")).select(*PLACE, "number")
        won = self._winners().select(*[F.col(f"first.{c}") for c in PLACE], "first.number")
        parts = [self._steps(rows.where(after(start)), every, ends, ok).select("step", F.lit(won_too).alias("won"))
                 for rows, ok, won_too in ((valid.select(*PLACE, "number"), True, 0), (other, False, 0), (won, True, 1))]
        n = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("step").agg(
            F.sum(1 - F.col("won")).alias("rows"), F.sum("won").alias("won"))
        return {r["step"]: (r["rows"], r["won"]) for r in n.collect()}

    def counts(self, start: tuple | None = None, end: tuple | None = None) -> tuple[int, int]:
        """(rows processed, rows to be stored) of a range of places."""
        if start is None and end is None:
            processed = self.scan.n_data
            if processed is None:
                processed = self.splits.agg(F.sum("data")).first()[0] or 0
            return int(processed), self.n_winners
        processed = self.scan.data().where(after(start) & up_to(end)).count()
        winners = self._winners().select(*[F.col(f"first.{c}") for c in PLACE]).where(after(start) & up_to(end))
        return int(processed), winners.count()

    def every(self, step_rows: int) -> int:
        """Valid rows of a step: whole flushes."""
        return max(1, step_rows // self.batch_size) * self.batch_size

    def boundaries(self, step_rows: int) -> list[tuple]:
        """(place, line_number) of the last valid row of every ``step_rows``-th flush; a row per step reaches the driver."""
        every = self.every(step_rows)
        valid, _ = split_rows(self.scan, self.spec)
        s = self.splits.select("file_seq", "split", "valid_before", "first_valid", "first", "lines_before")
        rows = valid.join(s, ["file_seq", "split"]).withColumn("_nth", F.col("valid_before") + F.col("number") - F.col("first_valid") + 1)
        ends = rows.where(F.col("_nth") % every == 0).select(*PLACE, (F.col("at") - F.col("first") + F.col("lines_before") + 1).alias("line"))
        return sorted((tuple(r[c] for c in PLACE), r["line"]) for r in ends.collect())

    def release(self) -> None:
        self.firsts.unpersist()
        self.splits.unpersist()


@dataclass
class SmallOutcome(ScanOutcome):
    """The outcome of few rows that are in one partition (``scan.placed``), by windows over them.

    ``rows`` has one row each with its numbers, its flush and what becomes of it, and is cached.
    """

    rows: DataFrame | None = None

    def invalid(self) -> DataFrame:
        return self.rows.where(~F.col("ok")).select(*PLACE, "line_number", "batch_no", "violations")

    def duplicates(self) -> DataFrame:
        rows = self.rows.where(F.col("ok") & ~F.col("won"))
        return rows.select(*PLACE, "line_number", "batch_no", F.col(f"{self.spec.key}_value").alias("value"),
                           F.when(F.col("in_flush"), F.lit(MSG["dup_file"])).otherwise(F.lit(MSG["dup_existing"])).alias("message"))

    def accepted(self, start: tuple | None = None, end: tuple | None = None, steps: tuple[int, list] | None = None) -> DataFrame:
        rows = self.rows.where(F.col("won") & after(start) & up_to(end))
        extra = [] if steps is None else ["step"]
        rows = rows if steps is None else self._steps(rows, *steps)
        return rows.select("file_seq", "ordinal", *extra, *[F.col(f"{f.name}_value").alias(f.name) for f in self.spec.fields])

    def _steps(self, rows: DataFrame, every: int, ends: list[tuple], valid_rows: bool = True) -> DataFrame:
        return rows.join(self._earlier(ends), "file_seq").withColumn(
            "step", (F.col("_earlier") + F.floor(F.col("valid_before") / F.lit(every))).cast("bigint")).drop("_earlier")

    def step_counts(self, every: int, ends: list[tuple], start: tuple | None = None) -> dict[int, tuple[int, int]]:
        rows = self._steps(self.rows.where(after(start)), every, ends)
        n = rows.groupBy("step").agg(F.count("*").alias("rows"), F.sum(F.col("won").cast("bigint")).alias("won"))
        return {r["step"]: (r["rows"], r["won"]) for r in n.collect()}

    def counts(self, start: tuple | None = None, end: tuple | None = None) -> tuple[int, int]:
        if start is None and end is None:
            return super().counts()
        n = self.rows.where(after(start) & up_to(end)).agg(F.count("*").alias("rows"), F.sum(F.col("won").cast("bigint")).alias("won")).first()
        return n["rows"], n["won"] or 0

    def boundaries(self, step_rows: int) -> list[tuple]:
        ends = self.rows.where(F.col("ok") & ((F.col("valid_before") + 1) % self.every(step_rows) == 0)).select(*PLACE, "line_number")
        return sorted((tuple(r[c] for c in PLACE), r["line_number"]) for r in ends.collect())

    def release(self) -> None:
        self.rows.unpersist()


def small_outcome(scan: CsvScan, lookup: Callable[[DataFrame], DataFrame], batch_size: int, spec: DataSpec) -> SmallOutcome:
    """``scan_outcome`` of few rows in one partition."""
    key = F.col(f"{spec.key}_value")
    rows = scan.rows.withColumn("ok", F.col("is_valid") & ~F.col("is_blank") & ~F.col("is_header"))
    known = lookup(rows.where("ok").select(key.alias("email"))).select(F.col("email").alias("_known"))
    lines = F.col("line_number") if scan.n_files == 1 else F.row_number().over(Window.orderBy(*PLACE)).cast("bigint")
    before = Window.partitionBy("file_seq").orderBy("split", "at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", lines.alias("ordinal"), F.coalesce(F.sum(F.col("ok").cast("bigint")).over(before), F.lit(0)).alias("valid_before"))
    rows = rows.where(~F.col("is_header") & ~F.col("is_blank")).withColumn("batch_no", F.floor(F.col("valid_before") / F.lit(batch_size)).cast("bigint"))
    here = F.struct(*PLACE, "batch_no")
    rows = rows.join(known, key == F.col("_known"), "left").withColumn("_first", F.min(F.when(F.col("ok"), here)).over(Window.partitionBy(key)))
    new = F.col("ok") & F.col("_known").isNull()
    in_flush = new & (F.col("_first.file_seq") == F.col("file_seq")) & (F.col("_first.batch_no") == F.col("batch_no"))
    rows = rows.withColumn("won", F.coalesce(new & (F.col("_first") == here), F.lit(False))).withColumn("in_flush", in_flush)
    rows = rows.drop("_first", "_known").persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.agg(F.count("*").alias("rows"), F.sum(F.col("won").cast("bigint")).alias("won")).first()
    return SmallOutcome(replace(scan, n_data=n["rows"]), spec, batch_size, None, None, [], int(n["won"] or 0), rows)


def split_rows(scan: CsvScan, spec: DataSpec) -> tuple[DataFrame, DataFrame]:
    """(valid rows: key, place, number; other rows: place, number, violations), numbered within their task."""
    ok = F.col("is_valid") & ~F.col("is_blank") & ~F.col("is_header")
    valid = scan.rows.where(ok).select(F.col(f"{spec.key}_value").alias("key"), *PLACE, F.monotonically_increasing_id().alias("number"))
    other = scan.rows.where(~ok).select(*PLACE, "is_header", "is_blank", "violations", F.monotonically_increasing_id().alias("number"))
    return valid, other


def scan_outcome(scan: CsvScan, lookup: Callable[[DataFrame], DataFrame], batch_size: int = DEFAULT_BATCH_SIZE,
                 spec: DataSpec = STUDENTS) -> ScanOutcome:
    """Plan the outcome of scanned rows (kept by ``keep_validated``); ``lookup`` gives the registered ones of keys (email)."""
    if scan.placed:
        return small_outcome(scan, lookup, batch_size, spec)
    valid, other = split_rows(scan, spec)
    none = F.lit(None).cast("bigint")
    numbers = valid.select("file_seq", "split", F.col("number").alias("v"), none.alias("o")).unionByName(
        other.select("file_seq", "split", none.alias("v"), F.col("number").alias("o")))
    numbers = numbers.groupBy("file_seq", "split").agg(F.min("v").alias("first_valid"), F.min("o").alias("first_other"))
    splits = scan.splits.join(numbers, ["file_seq", "split"], "left").persist(StorageLevel.MEMORY_AND_DISK)
    firsts = valid.groupBy("key").agg(F.min(F.struct(*PLACE, "number")).alias("first"), F.count("*").alias("_n")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    known = lookup(firsts.select(F.col("key").alias("email"))).select(F.col("email").alias("key"), F.lit(True).alias("_known"))
    marked = firsts.join(known, "key", "left").select("key", "first", "_n", F.coalesce("_known", F.lit(False)).alias("registered")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    hot = [] if scan.lines <= skew.HOT_ROWS else hot_keys(marked, "key")
    winners = marked.agg(F.sum((~F.col("registered")).cast("bigint"))).first()[0] or 0
    firsts.unpersist()
    return ScanOutcome(scan, spec, batch_size, splits, marked, hot, int(winners))


# ---- durable progress: an import that stops and goes on inside a file ----------------------


class Progress:
    """How far an import has come, in a folder of small files: one is added before and after each step.

    A step is noted with its reserved milliseconds before its rows are appended and entered as done
    afterwards.  The rows that a step has stored are known by their ids, so a step that was noted
    only (the run died in it) is done again without storing or counting a row twice, and rows of
    earlier steps are told from those that were registered before.
    """

    def __init__(self, spark, path: str | None):
        self.spark, self.path = spark, path.rstrip("/") if path else None
        names = sorted(n for n in names_in(spark, self.path) if n.endswith(".json")) if self.path else []
        self.entries = [json.loads(read_small(spark, f"{self.path}/{n}")) for n in names]

    @property
    def done(self) -> dict | None:
        """The last step that was finished."""
        return next((e for e in reversed(self.entries) if e["state"] == "done"), None)

    @property
    def open(self) -> dict | None:
        """A step that was begun and not finished."""
        return self.entries[-1] if self.entries and self.entries[-1]["state"] == "noted" else None

    def add(self, **entry) -> None:
        if self.path is None:
            return
        if not create_exclusive(self.spark, f"{self.path}/{len(self.entries):012d}.json", json.dumps(entry)):
            raise RuntimeError(f"Another run has gone on from {self.path}")
        self.entries.append(entry)

    def own(self, target: DataFrame, entry: dict | None = None) -> DataFrame:
        """Rows of the target that these steps, or one of them, have stored."""
        some = [entry] if entry else self.entries
        mine = F.lit(False)
        for first, count in sorted({(e["first_ms"], e["count"]) for e in some}):
            mine = mine | uuid7_millis(F.col("id")).between(first, first + count - 1)
        return target.where(mine)


def place_of(scan: CsvScan, file_path: str, line: int) -> tuple:
    """The place of a line of a file in this scan."""
    of = scan.files.where(F.col("file_path") == file_path).select("file_seq")
    inside = (F.col("lines_before") < line) & (F.col("lines_before") + F.col("lines") >= line)
    r = scan.splits.join(of, "file_seq").where(inside).first()
    if r is None:
        raise ValueError(f"{file_path} has no line {line}: it isn't the file that was imported before")
    return r["file_seq"], r["split"], r["first"] + line - r["lines_before"] - 1


NOWHERE, EVERYWHERE = (-1, 0, 0), (1 << 30, 0, 0)  # places before and after all rows


@dataclass
class Steps:
    begin: tuple | None   # the last place that earlier runs have done
    end: tuple | None     # the last place that this run has done (None: all)
    processed: int
    imported: int
    before: dict          # processed and imported of earlier runs
    aborted: bool = False


def registered_now(spark, target: str, keys: DataFrame, progress: Progress, few: bool = False) -> tuple[DataFrame, str]:
    """(those of the keys, few or many, that were registered before this import began, the scratch table they are in)."""
    from tollgate.sinks.table import read_target, snapshot_keys

    snap = snapshot_keys(spark, target, keys, few)
    if not progress.entries:
        return snap, snap._tollgate_path
    return snap.join(progress.own(read_target(spark, target)).select("email"), "email", "left_anti"), snap._tollgate_path


def run_steps(out: ScanOutcome, target: str, run_ts, progress: Progress, step_rows: int | None = None,
              should_stop: Callable[[int], bool] | None = None, seen: set[str] | None = None) -> Steps:
    """Append the accepted rows, step by step where that is asked for, from where ``progress`` ends.

    A step ends with a flush of the reference's loop, so results don't depend on the steps.  Before
    each one ``should_stop`` (rows this run has processed) is asked; a stop leaves what was flushed.
    ``seen``: the target's files as of the look-up of the keys.

    Steps between which nothing says stop are published and entered together, in groups
    (``StagedSteps``).  A group in which an earlier run died is done again as a whole.
    """
    from tollgate.sinks.table import append_new, read_target, reserve_millis

    spark, scan, last, interrupted = progress.spark, out.scan, progress.done, progress.open
    before = {"processed": last["processed"], "imported": last["imported"]} if last else {"processed": 0, "imported": 0}
    begin = None if last is None else EVERYWHERE if last["file_path"] is None else place_of(scan, last["file_path"], last["lines"])
    if begin == EVERYWHERE:
        return Steps(begin, None, 0, 0, before)
    all_ends = out.boundaries(step_rows) if step_rows else []
    ends = [(p, line) for p, line in all_ends if begin is None or p > begin]
    names = {k: path for k, path, _ in scan.listing}
    count, start, processed, imported, staged = millis_needed(scan.lines), begin, 0, 0, None

    def aborted() -> Steps:
        return Steps(begin, start or NOWHERE, processed, imported, before, True)

    def mark(end: tuple | None, line: int | None, first_ms: int, n: int) -> dict:
        return {"file_path": names[end[0]] if end else None, "lines": line, "first_ms": first_ms, "count": n}

    def entered(rows: int, stored: int, end: tuple | None, note: dict) -> None:
        nonlocal processed, imported, start
        processed, imported, start = processed + rows, imported + stored, end
        progress.add(state="done", **note, processed=before["processed"] + processed, imported=before["imported"] + imported)

    if interrupted or not ends:
        if should_stop is not None and should_stop(0):
            return aborted()
        end, line = None, None
        if ends and interrupted["file_path"] is not None:
            end, line = place_of(scan, interrupted["file_path"], interrupted["lines"]), interrupted["lines"]
        note = mark(end, line, reserve_millis(spark, target, int(run_ts.timestamp() * 1000), count), count)
        progress.add(state="noted", **note)
        rows, offered = out.counts(start, end)
        stored = append_new(out.accepted(start, end), target, run_ts, "ordinal", offered, note["first_ms"], True, None if interrupted else seen).inserted
        if interrupted:  # rows that were stored when it was interrupted are its own, not skipped
            stored += progress.own(read_target(spark, target), interrupted).count()
            seen = None  # files of others may have come since the look-up: the next steps ask all of the target
        entered(rows, stored, end, note)
        if end is None:
            return Steps(begin, None, processed, imported, before)
        ends = [(p, line) for p, line in ends if p > end]
    try:
        first = len(all_ends) - len(ends)
        for a, b in step_groups(first, len(all_ends) + 1, out.every(step_rows)):
            stop, rows = b, processed
            for step in range(a, b):
                if should_stop is not None and should_stop(rows):
                    stop = step
                    break
                if staged is None:
                    staged = StagedSteps(out, target, run_ts, out.every(step_rows), all_ends, first, start, seen, count)
                rows += staged.counts.get(step, (0, 0))[0]
            if stop > a:
                end, line = [*all_ends, (None, None)][stop - 1]
                note = mark(end, line, staged.millis(a), count * (stop - a))
                progress.add(state="noted", **note)
                entered(*staged.publish(a, stop, b, start), end, note)
            if stop < b:
                return aborted()
    finally:
        if staged:
            staged.release()
    return Steps(begin, None, processed, imported, before)


def step_groups(first: int, end: int, every: int) -> list[tuple[int, int]]:
    """Steps from ``first`` to before ``end`` in groups: one step, then two, four and so on, up to as many as a file takes."""
    from tollgate.sinks.table import STEP_FILE_ROWS

    groups, size = [], 1
    while first < end:
        groups.append((first, min(first + size, end)))
        first, size = groups[-1][1], min(2 * size, max(1, STEP_FILE_ROWS // every))
    return groups


class StagedSteps:
    """The rows of the steps to come, written ahead in groups; a group is published by moving its files.

    The steps' milliseconds are reserved together.  A first write has some steps, the next ones more
    and more, so that a run that is stopped soon hasn't written all.  The target is listed again
    before a group once ``LIST_SECONDS`` are over: if another writer has added files, what is written
    ahead is written again without the keys of those.
    """

    LIST_SECONDS = 2.0
    AHEAD, MORE = 64, 8  # steps of the first write, and how many times as many of each next one

    def __init__(self, out: ScanOutcome, target: str, run_ts, every: int, ends: list[tuple], first: int, start: tuple | None,
                 seen: set[str] | None, count: int):
        from tollgate.sinks.table import reserve_millis

        self.spark, self.out, self.target, self.run_ts, self.every, self.ends = out.scan.rows.sparkSession, out, target, run_ts, every, ends
        self.first, self.count, self.folders, self.path, self.ahead = first, count, set(), None, self.AHEAD
        self.looked_up, self.own, self.until = seen, set(), first  # the files as of the look-up, those moved here, the step after the last one written
        self.groups = step_groups(first, len(ends) + 1, every)
        self.first_ms = reserve_millis(self.spark, target, int(run_ts.timestamp() * 1000), count * (len(ends) + 1 - first))
        self.counts = out.step_counts(every, ends, start)

    def millis(self, step: int) -> int:
        return self.first_ms + (step - self.first) * self.count

    def _stage(self, step: int, start: tuple | None) -> None:
        """Write the steps from ``step``, which begins behind ``start``, to before ``until``."""
        from tollgate.sinks.table import GROUP, registered_keys, stage_steps, staged_files, staged_rows, to_stored, without_later

        self.release()
        self.known, self.listed = set(list_files(self.spark, self.target)), time.monotonic()
        end = self.ends[self.until - 1][0] if self.until <= len(self.ends) else None
        rows = self.out.accepted(start, end, steps=(self.every, self.ends))
        later = None if self.looked_up is None else sorted(self.known - self.looked_up - self.own)
        if later is None:
            rows = rows.join(registered_keys(self.spark, self.target), on="email", how="left_anti")
        else:
            rows = without_later(rows, later)
        of = [(s, a) for a, b in self.groups for s in range(a, b) if step <= s < self.until]
        rows = rows.join(F.broadcast(local_rows(self.spark, of, {"step": "int64", GROUP: "int64"})), "step")  # a row per step
        millis = F.lit(self.first_ms) + (F.col("step") - F.lit(self.first)) * F.lit(self.count)
        group_rows = self.every * max((b - a for a, b in self.groups), default=1)
        self.path = stage_steps(to_stored(rows, self.run_ts, "ordinal", millis, ("step", GROUP)), self.target, group_rows)
        self.files = staged_files(self.spark, self.path)
        if later is None or later:  # keys that others have stored meanwhile are not stored again
            files = [f for some in self.files.values() for f in some]
            left = staged_rows(self.spark, files).groupBy("step").count().collect() if files else []
            stored = {r["step"]: r["count"] for r in left}
            self.counts |= {s: (self.counts[s][0], stored.get(s, 0)) for s, _ in of if s in self.counts}

    def publish(self, a: int, stop: int, b: int, start: tuple | None) -> tuple[int, int]:
        """(rows processed, rows stored) of the steps from ``a``, which begins behind ``start``, to before ``stop``, of a group up to ``b``."""
        from tollgate.sinks.table import publish_step, staged_rows, store

        if a >= self.until:
            self.until, self.ahead = next((y for _, y in self.groups if y >= a + self.ahead), len(self.ends) + 1), self.ahead * self.MORE
            self._stage(a, start)
        elif time.monotonic() - self.listed > self.LIST_SECONDS:
            now = set(list_files(self.spark, self.target))
            if now - self.known - self.own:
                self._stage(a, start)
            self.listed = time.monotonic()
        files = self.files.get(a, [])
        if stop == b:
            self.own |= set(publish_step(self.spark, self.target, a, files, self.folders))
        elif files:  # a stop inside the group: its first steps only
            store(staged_rows(self.spark, files).where(F.col("step") < stop), self.target)
        parts = [self.counts.get(s, (0, 0)) for s in range(a, stop)]
        return sum(n for n, _ in parts), sum(n for _, n in parts)

    def release(self) -> None:
        if self.path is not None:
            remove_path(self.spark, self.path)
            self.path = None


# ---- whole-file import: scan -> outcome -> append -> report -> result ----------------------

@dataclass
class ImportResult:
    total_processed: int
    total_imported: int
    total_errors: int
    errors: list            # first 100 violations in report order
    duration_ms: int
    rows_per_second: int
    error_report_path: str | None
    aborted: bool = False
    file_errors: Mapping | None = None  # by path: the first 100 violations of each file


def import_csv(
    spark,
    paths,
    target: str,
    batch_size: int = DEFAULT_BATCH_SIZE,
    max_row_bytes: int = 64 * 1024,
    report_dir: str | None = None,
    run_ts=None,
    progress: str | None = None,
    step_rows: int | None = None,
    should_stop: Callable[[int], bool] | None = None,
) -> ImportResult:
    """Import CSV file(s) into the Parquet target at ``target`` (created when absent).

    Several files are imported in path order as consecutive jobs: the flush key is ``(file_seq,
    batch_no)`` and a key first seen in an earlier file counts as already registered.  Nothing is
    written unless header and size checks pass; the driver receives counters and one sample of 100
    rows, those of each file when they are asked for.

    With ``step_rows`` rows are appended in steps of about as many, each ending with a flush.
    Before a step ``should_stop`` is asked with the rows processed so far: a stop returns
    ``aborted`` with the counts of what was flushed.  With ``progress`` (a folder) each step is
    entered there, and a later call with the same folder and files goes on at the next row, also
    after a crash; it counts only the rows it processes itself.
    """
    import datetime as dt
    import time

    from tollgate.sinks.csv_text import write_report
    from tollgate.sinks.table import create_target

    if not isinstance(batch_size, int) or isinstance(batch_size, bool) or not 1 <= batch_size <= 10_000:
        raise ValueError("batch size must be an integer between 1 and 10000")
    started = time.monotonic()
    run_ts = run_ts or dt.datetime.now(dt.timezone.utc)
    if not path_exists(spark, target):
        create_target(spark, target)
    steps_done = Progress(spark, progress)
    scan = scan_lines(read_lines(spark, paths), REQUIRED_COLUMNS, max_row_bytes, columns=REQUIRED_COLUMNS, keep=keep_validated())
    out, made = None, []
    try:
        seen = set(list_files(spark, target))

        def lookup(keys: DataFrame) -> DataFrame:
            known, path = registered_now(spark, target, keys, steps_done)
            made.append(path)
            return known

        out = scan_outcome(scan, lookup, batch_size)
        steps = run_steps(out, target, run_ts, steps_done, step_rows, should_stop, seen)
        processed, errors = steps.processed, steps.processed - steps.imported
        rejected = out.rejections(steps.begin, steps.end)
        samples = FileErrors(scan, rejected) if errors else {}
        sample = samples.first() if errors else []
        report = None
        if errors > 0 and report_dir:
            report = write_report(rejected, report_dir, run_ts, ["file_seq"], files=scan.files if scan.n_files > 1 else None)
    finally:
        if out is not None:
            out.release()
        scan.release()
        for path in made:
            remove_path(spark, path)
    duration = int(round((time.monotonic() - started) * 1000))
    return ImportResult(
        total_processed=processed,
        total_imported=steps.imported,
        total_errors=errors,
        errors=sample,
        duration_ms=duration,
        rows_per_second=int((processed * 1000 + duration // 2) // duration) if duration > 0 else processed,
        error_report_path=report,
        aborted=steps.aborted,
        file_errors=samples,
    )


class FileErrors(Mapping):
    """By path the first 100 violations of each file, in report order.

    They are in a table (``rows``: file_seq, file_path and a report row's columns) under the shared
    scratch folder, which is the caller's to remove; a file's are read when they are asked for.
    """

    COLUMNS = ("line_number", "field", "value", "message")

    def __init__(self, scan: CsvScan, rejected: DataFrame):
        self.path = scratch_path(rejected.sparkSession, "file-samples")
        top = scan.with_path(file_samples(rejected)).select("file_path", *order_key(["file_seq"]), *self.COLUMNS[1:])
        top.write.parquet(self.path)
        self.rows = rejected.sparkSession.read.schema(top.schema).parquet(self.path)
        self._paths: list[str] | None = None

    def first(self, n: int = MAX_ERRORS_IN_RESULT) -> list[dict]:
        """The first ``n`` of all files together."""
        return [r.asDict() for r in self.rows.orderBy(*order_key(["file_seq"])).limit(n).select("file_seq", *self.COLUMNS).collect()]

    def __getitem__(self, path: str) -> list[dict]:
        rows = self.rows.where(F.col("file_path") == path).orderBy(*order_key()).select("file_seq", *self.COLUMNS).collect()
        if not rows:
            raise KeyError(path)
        return [r.asDict() for r in rows]

    def __iter__(self) -> Iterator[str]:
        if self._paths is None:
            self._paths = [r[0] for r in self.rows.select("file_path").distinct().orderBy("file_path").collect()]
        return iter(self._paths)

    def __len__(self) -> int:
        return len(list(iter(self)))
