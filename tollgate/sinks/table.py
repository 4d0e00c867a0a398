"""The target table: schema, keyed look-up, append of new keys, audits.

The table is laid out by key: a folder for each bucket of the email's hash, as
many as the table was created with (``_buckets``).  A look-up reads the email
column of the buckets that its keys fall in and of no other.

Spark does not enforce PK / UNIQUE / NOT NULL, so they are an audit job, and the
insert-ignore of the reference becomes a ``left_anti`` join right before the
append.  A run that has looked its keys up already only meets the files that
came after its look-up, usually none.

Ids take their time from a clock in the table's folder (``_clock``): a run
reserves its milliseconds there before it writes, by a file that only one
writer can create, so no two runs share one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.ids import millis_needed, row_counter, row_millis, uuid7
from tollgate.plans.spec import STORED_STUDENTS, validate, violation_message
from tollgate.session import create_exclusive, list_files, make_folder, move_files, names_in, read_small, scratch_path

# The stored students table (lengths of the reference's columns).
STUDENTS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),          # VARCHAR(36) primary key
    T.StructField("name", T.StringType(), False),        # VARCHAR(100)
    T.StructField("email", T.StringType(), False),       # VARCHAR(255) unique
    T.StructField("enrollment_date", T.DateType(), False),
    T.StructField("course_id", T.StringType(), False),   # VARCHAR(36), indexed
    T.StructField("score", T.DecimalType(5, 2), False),
    T.StructField("created_at", T.TimestampType(), True),
])
COLUMN_LIMITS = {"id": 36, "name": 100, "email": 255, "course_id": 36}
CORRUPTED_ROW = "Corrupted student row "


BUCKET = "key_bucket"
KEY_BUCKETS = 16  # of a new table; a look-up of few keys reads their share of the buckets


def key_bucket(email: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(email), F.lit(buckets)).cast("int")


def create_target(spark: SparkSession, path: str, buckets: int = KEY_BUCKETS) -> None:
    """An empty table with the students schema, laid out in ``buckets`` folders."""
    empty = spark.createDataFrame([], STUDENTS_SCHEMA).withColumn(BUCKET, F.lit(0))
    empty.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    create_exclusive(spark, f"{path.rstrip('/')}/_buckets", str(buckets))


def bucket_count(spark: SparkSession, path: str) -> int:
    return int(read_small(spark, f"{path.rstrip('/')}/_buckets") or KEY_BUCKETS)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*STUDENTS_SCHEMA.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(path)


def read_target(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path).select(*STUDENTS_SCHEMA.names)


def registered_keys(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """The registered keys of the target (only the email column is read), of the ``wanted`` buckets or of all."""
    rows = _read(spark, path)
    if wanted is not None:
        rows = rows.where(F.col(BUCKET).isin(wanted) if wanted else F.lit(False))
    return rows.select("email")


def wanted_buckets(candidates: DataFrame, buckets: int) -> list[int]:
    """The buckets that the candidates' emails fall in: at most ``buckets`` numbers."""
    rows = candidates.where(F.col("email").isNotNull()).select(key_bucket(F.col("email"), buckets).alias("b")).distinct().collect()
    return sorted(r["b"] for r in rows)


def snapshot_keys(spark: SparkSession, path: str, candidates: DataFrame | None = None, few: bool = False) -> DataFrame:
    """The registered keys as of now, cut from the target's lineage.

    With ``candidates`` (email) only those of them that are registered, so that what is read,
    shuffled and written follows the batch and not the target.  ``few``: candidates that are known to
    be few are sent to the target's keys, which stay where they are read.

    Spark re-caches every cached plan that reads a path when that path is
    written, so a plan reading the target lazily would see rows appended later
    (by this run or a concurrent writer).  The key set is written once as a
    Parquet table under ``spark.checkpoint.dir`` (shared, survives executor
    loss) and read back: that freezes it at run start.  ``_tollgate_path`` of
    the result names it, for the run to remove.
    """
    snap = scratch_path(spark, "registered-keys")
    if candidates is None:
        keys = registered_keys(spark, path).distinct()
    else:
        keys = registered_keys(spark, path, wanted_buckets(candidates, bucket_count(spark, path)))
        wanted = candidates.select("email").where(F.col("email").isNotNull())
        if few:
            keys = keys.join(F.broadcast(wanted), "email", "left_semi").distinct()
        else:
            keys = wanted.distinct().join(keys, "email", "left_semi")
    keys.write.parquet(snap)
    out = spark.read.schema("email string").parquet(snap)
    out._tollgate_path = snap  # type: ignore[attr-defined]
    return out


def reserve_millis(spark: SparkSession, path: str, run_ms: int, count: int = 1) -> int:
    """The first of ``count`` milliseconds, ``run_ms`` or later, that no other run of this target has."""
    clock = f"{path.rstrip('/')}/_clock"
    while True:
        taken = [tuple(map(int, n.split("-"))) for n in names_in(spark, clock) if n[:1].isdigit()]
        first = max([run_ms, *[a + n for a, n in taken]])
        # one file a reservation; of two writers that see the same clock only one creates it
        if create_exclusive(spark, f"{clock}/{first}-{count}"):
            return first


def to_stored(rows: DataFrame, run_ts: dt.datetime, ordinal: str = "line_number", first_ms: int | Column | None = None,
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed target rows with a uuid7 id per row and the run's created_at.

    ``ordinal`` is the row's position in the whole input, ``first_ms`` the first millisecond that
    is reserved for the run or the row's step (by default its time), ``keep`` are columns to go along.
    """
    run_ms = F.lit(int(run_ts.timestamp() * 1000) if first_ms is None else first_ms).cast("bigint")
    return rows.select(
        uuid7(row_millis(run_ms, F.col(ordinal)), row_counter(F.col(ordinal)), F.col("email")).alias("id"),
        "name",
        "email",
        F.col("enrollment_date").cast("date").alias("enrollment_date"),
        "course_id",
        F.col("score").cast("decimal(5,2)").alias("score"),
        F.lit(run_ts).cast("timestamp").alias("created_at"),
        *keep,
    )


def store(rows: DataFrame, path: str) -> int:
    """Append typed rows, each to its bucket; how many were written (observed on the way)."""
    spark = rows.sparkSession
    n = bucket_count(spark, path)
    # a bucket is written by as many tasks as there are shuffle partitions for it
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // n)
    written = Observation("stored rows")
    keyed = rows.select(*STUDENTS_SCHEMA.names).withColumn(BUCKET, key_bucket(F.col("email"), n))
    if spark.conf.get("spark.sql.shuffle.partitions") == "1":  # all would go to one task
        keyed = keyed.coalesce(1)
    else:
        keyed = keyed.repartition(BUCKET, F.pmod(F.xxhash64("id"), F.lit(tasks)))
    keyed = keyed.sortWithinPartitions(BUCKET, "id")
    keyed.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(BUCKET).parquet(path)
    return int(written.get["n"])


STEP, GROUP = "step", "step_group"
STEP_FILE_ROWS = 100_000  # rows of a group of steps that a task writes


def stage_steps(rows: DataFrame, path: str, group_rows: int) -> str:
    """Write typed rows with their ``step`` and its group, each group in a folder of its own beside the buckets; that folder's path.

    Nothing reads the folder (its name begins with ``_``) before ``publish_step`` moves a group's files.
    """
    staged = f"{path.rstrip('/')}/_steps-{uuid.uuid4().hex[:12]}"
    keyed = rows.withColumn(BUCKET, key_bucket(F.col("email"), bucket_count(rows.sparkSession, path)))
    parts = F.pmod(F.xxhash64("id"), F.lit(max(1, group_rows // STEP_FILE_ROWS)))
    keyed.repartition(GROUP, parts).sortWithinPartitions(GROUP, BUCKET, "id").write.partitionBy(GROUP, BUCKET).parquet(staged)
    return staged


def staged_files(spark: SparkSession, staged: str) -> dict[int, list[str]]:
    """The files of each staged group."""
    out: dict[int, list[str]] = {}
    for f in list_files(spark, staged, depth=2):
        out.setdefault(int(f.rsplit("/", 3)[1].split("=")[1]), []).append(f)
    return out


def staged_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """The rows of staged files, with their ``step``."""
    fields = [*STUDENTS_SCHEMA.fields, T.StructField(STEP, T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(*files)


def publish_step(spark: SparkSession, path: str, step: int, files: list[str], made: set[str]) -> list[str]:
    """Move the files of a group, which begins with ``step``, to their buckets: from now on they are the target's.

    ``made``: folders that are there.
    """
    root, moves = files[0].rsplit("/", 4)[0] if files else path, []
    for f in files:
        _, bucket, name = f.rsplit("/", 2)
        if bucket not in made:
            make_folder(spark, f"{root}/{bucket}")
            made.add(bucket)
        # a task gives its files in all folders one name
        moves.append((f, f"{root}/{bucket}/part-{step:09d}-{name[len('part-'):]}"))
    move_files(spark, moves)
    return [dst for _, dst in moves]


def without_later(rows: DataFrame, later: list[str]) -> DataFrame:
    """``rows`` whose email is not in files of the target that came after the look-up of their keys."""
    return rows.join(rows.sparkSession.read.schema("email string").parquet(*later), on="email", how="left_anti") if later else rows


@dataclass
class AppendResult:
    offered: int    # unique rows of the run
    inserted: int   # rows really appended
    skipped: int    # keys that appeared in the target meanwhile (B2)


def append_new(accepted: DataFrame, path: str, run_ts: dt.datetime, ordinal: str = "line_number",
               offered: int | None = None, first_ms: int | None = None, distinct_keys: bool = False,
               seen: set[str] | None = None, max_ordinal: int = 0) -> AppendResult:
    """B1/B2: append rows whose email is not in the target *now*; count both sides.

    Of several rows with one email the first by ``ordinal`` is inserted; ``distinct_keys`` says that
    there are none.  ``offered`` (the row count) is counted here unless the caller already knows it.
    ``seen`` are the target's files as of the caller's look-up of these keys: only later ones are
    asked again.  ``first_ms``: reserved milliseconds; by default some are reserved here, enough for
    ordinals up to ``max_ordinal``.
    """
    spark = accepted.sparkSession
    first = accepted
    if not distinct_keys:
        row = F.struct(*[F.col(c) for c in accepted.columns])
        first = accepted.groupBy("email").agg(F.min_by(row, F.col(ordinal)).alias("_row")).select("_row.*")
    if seen is None:
        first = first.join(registered_keys(spark, path), on="email", how="left_anti")
    else:
        first = without_later(first, sorted(set(list_files(spark, path)) - seen))
    if first_ms is None:
        first_ms = reserve_millis(spark, path, int(run_ts.timestamp() * 1000), millis_needed(max_ordinal))
    if offered is None:
        offered = accepted.count()
    inserted = store(to_stored(first, run_ts, ordinal, first_ms), path)
    return AppendResult(offered, inserted, offered - inserted)


def readback_audit(stored: DataFrame) -> DataFrame:
    """Stored rows that break a rule, as ``Corrupted student row <id>: <messages>``."""
    as_text = stored.select(
        "id", "name", "email",
        F.date_format("enrollment_date", "yyyy-MM-dd").alias("enrollment_date"),
        "course_id",
        F.col("score").cast("string").alias("score"),
    )
    v = validate(as_text, STORED_STUDENTS)
    message = F.concat(F.lit(CORRUPTED_ROW), F.col("id"), F.lit(": "), violation_message(F.col("violations")))
    # exploded, not filtered: a filter would be pushed below the rules' projections, with a copy of all
    # that a rule refers to wherever it does
    return v.select("id", F.explode(F.when(~F.col("is_valid"), F.array(message))).alias("message"))


def constraint_audit(rows: DataFrame) -> DataFrame:
    """K5: PRIMARY KEY id, UNIQUE email, NOT NULL and length violations as (constraint, key, rows)."""
    dup_id = rows.groupBy("id").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(
        F.lit("primary_key_id").alias("constraint"), F.col("id").alias("key"), F.col("rows").cast("bigint"))
    dup_email = rows.groupBy("email").agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(
        F.lit("unique_email").alias("constraint"), F.col("email").alias("key"), F.col("rows").cast("bigint"))
    checks = []
    for c in ["id", "name", "email", "enrollment_date", "course_id", "score"]:
        checks.append(F.when(F.col(c).isNull(), F.lit(f"not_null_{c}")))
    for c, n in COLUMN_LIMITS.items():
        checks.append(F.when(F.length(c) > n, F.lit(f"length_{c}")))
    per_row = rows.select(F.col("id").alias("key"), F.explode(F.array(*checks)).alias("constraint")) \
        .where(F.col("constraint").isNotNull()).select("constraint", "key", F.lit(1).cast("bigint").alias("rows"))
    return dup_id.unionByName(dup_email).unionByName(per_row)
