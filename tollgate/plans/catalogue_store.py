"""Registered queries for the target table, JDBC, ids, slug and the generator.

Target-table queries seed a fresh Parquet table (under the shared checkpoint
area) with the registered customers, run the import of ``raw_students``
against it and read the result back.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions import rules as R
from tollgate.functions.ids import row_counter, uuid7, uuid7_timestamp, uuid7_version
from tollgate.functions.slug import slug
from tollgate.operators.inversions import order_inversions
from tollgate.plans import oracle as O
from tollgate.plans.catalogue import BATCH, register
from tollgate.plans.pipeline import accepted_rows, outcome
from tollgate.plans.spec import STUDENTS, validate
from tollgate.session import scratch_path
from tollgate.sinks import jdbc as J
from tollgate.sinks import table as TB
from tollgate.sources import generate as G
from tollgate.sources.fixtures import raw_students, registered_students, table
from tollgate.sources.generate import apply_corruption, generate_students

RUN_TS = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
RUN_MS = int(RUN_TS.timestamp() * 1000)
SEED_TS = dt.datetime(2025, 12, 31, tzinfo=dt.timezone.utc)


def seeded_target(spark: SparkSession, sf_dir: str, every: int = 10) -> str:
    path = scratch_path(spark, "students-target")
    TB.create_target(spark, path)
    reg = registered_students(spark, sf_dir, every).select(
        *[F.col(c) for c in ["id", "name", "email", "enrollment_date", "course_id"]],
        F.col("score").cast("decimal(5,2)").alias("score"),
        F.lit(SEED_TS).cast("timestamp").alias("created_at"),
    )
    TB.store(reg, path)
    return path


def imported_target(spark: SparkSession, sf_dir: str) -> tuple[str, TB.AppendResult]:
    path = seeded_target(spark, sf_dir)
    out = outcome(raw_students(spark, sf_dir), TB.snapshot_keys(spark, path), BATCH)
    res = TB.append_new(accepted_rows(out), path, RUN_TS)
    return path, res


def _typed(df: DataFrame) -> DataFrame:
    return df.select("name", "email", "enrollment_date", "course_id", F.col("score").cast("double").alias("score"))


_ALL_STUDENTS = """SELECT concat('00000000-0000-7000-8000-', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS id, c_name AS name,
  concat('user.', CAST(c_custkey AS VARCHAR), '@school.edu') AS email, DATE '2024-02-01' AS enrollment_date,
  concat('COURSE-', CAST(c_custkey % 50 AS VARCHAR)) AS course_id, CAST(((floor(c_acctbal) % 101) + 101) % 101 AS DOUBLE) AS score
FROM customer"""

_UNIQUE_ROWS = O.with_outcome(
    f"SELECT name_norm AS name, email_norm AS email, CAST(date_norm AS DATE) AS enrollment_date, course_norm AS course_id, "
    f"{O.score_value('score_norm')} AS score FROM oc2 WHERE status = 'unique'"
)


@register("students_schema", f"SELECT id, name, email, enrollment_date, course_id, score FROM ({_ALL_STUDENTS})")
def students_schema(spark, sf_dir):
    t = TB.read_target(spark, seeded_target(spark, sf_dir, every=1))
    return t.select("id", "name", "email", "enrollment_date", "course_id", F.col("score").cast("double").alias("score"))


@register("registered_keys_scan", f"SELECT email FROM ({_ALL_STUDENTS})")
def registered_keys_scan(spark, sf_dir):
    return TB.registered_keys(spark, seeded_target(spark, sf_dir, every=1))


@register("append_new_students", _UNIQUE_ROWS)
def append_new_students(spark, sf_dir):
    path, _ = imported_target(spark, sf_dir)
    return _typed(TB.read_target(spark, path).where(F.col("created_at") == F.lit(RUN_TS).cast("timestamp")))


@register(
    "target_count",
    O.with_outcome(f"SELECT CAST((SELECT count(*) FROM ({O.REGISTERED})) + count(*) AS BIGINT) AS row_count FROM oc2 WHERE status = 'unique'"),
)
def target_count(spark, sf_dir):
    path, _ = imported_target(spark, sf_dir)
    return TB.read_target(spark, path).agg(F.count("*").cast("bigint").alias("row_count"))


_CONCURRENT = "SELECT concat('user.', CAST(c_custkey AS VARCHAR), '@school.edu') AS email FROM customer WHERE c_custkey % 10 = 5"


@register(
    "skipped_at_write",
    O.with_outcome(
        f"SELECT CAST(count(*) AS BIGINT) AS offered, CAST(sum(CASE WHEN email_norm IN (SELECT email FROM ({_CONCURRENT})) THEN 0 ELSE 1 END) AS BIGINT) AS inserted, "
        f"CAST(sum(CASE WHEN email_norm IN (SELECT email FROM ({_CONCURRENT})) THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM oc2 WHERE status = 'unique'"
    ),
)
def skipped_at_write(spark, sf_dir):
    """B2: a second writer stores other customers between the snapshot and the append."""
    path = seeded_target(spark, sf_dir)
    out = outcome(raw_students(spark, sf_dir), TB.snapshot_keys(spark, path), BATCH)
    accepted = accepted_rows(out)
    c = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 10 == 5)
    rival = c.select(
        F.col("c_custkey").alias("line_number"), F.col("c_name").alias("name"),
        F.concat(F.lit("user."), F.col("c_custkey").cast("string"), F.lit("@school.edu")).alias("email"),
        F.lit("2024-02-01").cast("date").alias("enrollment_date"), F.lit("COURSE-1").alias("course_id"),
        F.lit(50.0).alias("score"),
    )
    TB.store(TB.to_stored(rival, SEED_TS), path)
    res = TB.append_new(accepted, path, RUN_TS)
    return spark.createDataFrame([(res.offered, res.inserted, res.skipped)], "offered bigint, inserted bigint, skipped bigint")


def _audit_sql() -> str:
    name_norm = O.collapse("c_name")
    return (
        f"SELECT id, 'Corrupted student row ' || id || ': name: ' || msg AS message FROM ("
        f"SELECT concat('00000000-0000-7000-8000-', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS id, {O.name_case(name_norm)} AS msg "
        f"FROM customer WHERE c_custkey % 10 = 0) WHERE msg IS NOT NULL"
    )


@register("readback_audit", _audit_sql())
def readback_audit(spark, sf_dir):
    path, _ = imported_target(spark, sf_dir)
    return TB.readback_audit(TB.read_target(spark, path))


_LIMIT_CASES = " UNION ALL ".join(
    f"SELECT 'length_{c}', id, 1 FROM bad WHERE length({c}) > {n}" for c, n in TB.COLUMN_LIMITS.items())


@register(
    "constraint_audit",
    O.with_validated(
        "SELECT 'unique_email' AS constraint, email_norm AS key, CAST(count(*) AS BIGINT) AS rows FROM val WHERE is_valid "
        "GROUP BY email_norm HAVING count(*) > 1 UNION ALL SELECT * FROM (WITH bad AS (SELECT 'page-' || CAST(page_id % 1000 AS VARCHAR) AS id, "
        "html AS name, CASE WHEN page_id % 3 > 0 THEN url END AS email, CASE WHEN page_id % 5 > 0 THEN 'C1' END AS course_id FROM pages) "
        "SELECT 'primary_key_id', id, count(*) FROM bad GROUP BY id HAVING count(*) > 1 "
        "UNION ALL SELECT 'unique_email', email, count(*) FROM bad GROUP BY email HAVING count(*) > 1 "
        "UNION ALL SELECT 'not_null_email', id, 1 FROM bad WHERE email IS NULL "
        "UNION ALL SELECT 'not_null_course_id', id, 1 FROM bad WHERE course_id IS NULL "
        f"UNION ALL {_LIMIT_CASES})"
    ),
)
def constraint_audit(spark, sf_dir):
    """K5 over the valid candidates as they would be stored without first-wins, and over pages taken for
    students (long names, missing cells, repeated ids), so that every kind of check fires."""
    v = validate(raw_students(spark, sf_dir), STUDENTS).where(F.col("is_valid"))
    rows = TB.to_stored(
        v.select("line_number", *[F.col(f"{f}_value").alias(f) for f in STUDENTS.field_names()]), RUN_TS
    )
    k = F.col("page_id")
    bad = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), (k % 1000).cast("string")).alias("id"), F.col("html").alias("name"),
        F.when(k % 3 > 0, F.col("url")).alias("email"), F.lit("2024-02-01").cast("date").alias("enrollment_date"),
        F.when(k % 5 > 0, F.lit("C1")).alias("course_id"), F.lit(50).cast("decimal(5,2)").alias("score"))
    return TB.constraint_audit(rows).unionByName(TB.constraint_audit(bad))


@register(
    "keyed_lookup",
    O.with_validated(f"SELECT DISTINCT email_norm AS email FROM val WHERE email_norm IN (SELECT email FROM ({O.REGISTERED}))"),
)
def keyed_lookup(spark, sf_dir):
    """The registered ones of a batch's keys, read from the buckets of the target that these keys fall in."""
    keys = raw_students(spark, sf_dir).select(R.norm_email(F.coalesce("email", F.lit(""))).alias("email"))
    return TB.snapshot_keys(spark, seeded_target(spark, sf_dir), keys)


@register(
    "id_clock",
    O.with_outcome("SELECT CAST(2 * count(*) AS BIGINT) AS ids, CAST(2 * count(*) AS BIGINT) AS distinct_ids, CAST(0 AS BIGINT) AS inversions, "
                   "CAST(0 AS BIGINT) AS shared_millis FROM oc2 WHERE status = 'unique'"),
)
def id_clock(spark, sf_dir):
    """C11: two runs of one time store the accepted rows, the second one under other emails; ids repeat nowhere,
    follow the input in both runs, and no millisecond is in both."""
    from tollgate.functions.ids import uuid7_millis

    path = seeded_target(spark, sf_dir)
    rows = accepted_rows(outcome(raw_students(spark, sf_dir), TB.snapshot_keys(spark, path), BATCH)).persist()
    TB.append_new(rows, path, RUN_TS)
    TB.append_new(rows.withColumn("email", F.concat(F.lit("second."), "email")), path, RUN_TS)
    stored = TB.read_target(spark, path).where(F.col("created_at") == F.lit(RUN_TS).cast("timestamp"))
    second = F.col("email").startswith("second.")
    stored = stored.select("id", second.alias("second"), F.when(second, F.substring("email", 8, 255)).otherwise(F.col("email")).alias("email"))
    at = rows.select("email", "line_number").join(stored, "email").select(
        "id", "second", (F.col("line_number") + F.when(F.col("second"), 1 << 40).otherwise(0)).alias("at"))
    counts = at.agg(F.count("*").alias("ids"), F.countDistinct("id").alias("distinct_ids"))
    shared = at.groupBy(uuid7_millis(F.col("id")).alias("ms")).agg(F.countDistinct("second").alias("runs")).agg(
        F.coalesce(F.sum(F.when(F.col("runs") > 1, 1)), F.lit(0)).cast("bigint").alias("shared_millis"))
    return counts.crossJoin(order_inversions(at, "at", {"inversions": "id"})).crossJoin(shared)


# ---- JDBC -----------------------------------------------------------------------

@register("jdbc_write", _UNIQUE_ROWS)
def jdbc_write(spark, sf_dir):
    url = J.derby_memory_url(f"tollgate_{uuid.uuid4().hex[:10]}")
    seed = registered_students(spark, sf_dir).select(
        "id", "name", "email", "enrollment_date", "course_id", F.col("score").cast("decimal(5,2)").alias("score"))
    J.write_table(seed, url, "students", mode="overwrite")
    out = outcome(raw_students(spark, sf_dir), J.lowercase_columns(J.read_table(spark, url, "students")).select("email"), BATCH)
    new = TB.to_stored(accepted_rows(out), RUN_TS).drop("created_at")
    J.insert_new(new, url, "students", key="email", batch_size=1000)
    back = J.lowercase_columns(J.read_table(spark, url, "students"))
    return _typed(back.join(seed.select("email"), "email", "left_anti"))


@register("jdbc_read", f"SELECT id, name, email, enrollment_date, course_id, score FROM ({_ALL_STUDENTS})")
def jdbc_read(spark, sf_dir):
    url = J.derby_memory_url(f"tollgate_{uuid.uuid4().hex[:10]}")
    c = table(spark, sf_dir, "customer")
    seed = registered_students(spark, sf_dir, every=1).join(
        c.select(F.concat(F.lit("user."), F.col("c_custkey").cast("string"), F.lit("@school.edu")).alias("email"),
                 F.col("c_custkey").alias("seq")), "email")
    J.write_table(seed.withColumn("score", F.col("score").cast("decimal(5,2)")), url, "registered", mode="overwrite")
    bounds = seed.agg(F.min("seq"), F.max("seq")).collect()[0]
    back = J.lowercase_columns(J.read_table(spark, url, "registered", "seq", int(bounds[0] or 0), int(bounds[1] or 0) + 1, 4))
    return back.select("id", "name", "email", "enrollment_date", "course_id", F.col("score").cast("double").alias("score"))


# ---- ids ------------------------------------------------------------------------

def _ids(spark, sf_dir) -> DataFrame:
    v = validate(raw_students(spark, sf_dir), STUDENTS).where(F.col("is_valid"))
    return v.select("line_number", uuid7(F.lit(RUN_MS), row_counter(F.col("line_number")), F.col("email_value")).alias("id"))


@register(
    "uuid7",
    O.with_validated("SELECT line_number, '7' AS version, CAST(36 AS BIGINT) AS id_length, true AS well_formed FROM val WHERE is_valid"),
)
def uuid7_q(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    return ids.select(
        "line_number",
        uuid7_version(F.col("id")).alias("version"),
        F.length("id").cast("bigint").alias("id_length"),
        F.col("id").rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z").alias("well_formed"),
    )


@register(
    "uuid7_timestamp",
    O.with_validated(f"SELECT line_number, make_timestamp({RUN_MS}::BIGINT * 1000) AS id_ts FROM val WHERE is_valid"),
)
def uuid7_timestamp_q(spark, sf_dir):
    return _ids(spark, sf_dir).select("line_number", uuid7_timestamp(F.col("id")).alias("id_ts"))


@register(
    "order_inversions",
    "SELECT CAST(0 AS BIGINT) AS uuid7_inversions, CAST(sum(CASE WHEN prev > o_orderdate THEN 1 ELSE 0 END) AS BIGINT) AS orderdate_inversions "
    "FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS prev FROM orders)",
)
def order_inversions_q(spark, sf_dir):
    """Adjacent pairs whose storage key decreases along insert order."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", uuid7(F.lit(RUN_MS), F.col("o_orderkey"), F.col("o_custkey")).alias("id"))
    return order_inversions(o, "o_orderkey", {"uuid7_inversions": "id", "orderdate_inversions": "o_orderdate"})


@register(
    "slug",
    "SELECT conv_id, turn, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS slug FROM conversations",
)
def slug_q(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", slug(F.col("text")).alias("slug"))


# ---- generator ------------------------------------------------------------------

# the first message that each corruption leads to (11, a repeated email, is no violation of a row)
_KIND_MESSAGE = {0: "email_pattern", 1: "email_required", 2: "score_range", 3: "score_range", 4: "score_decimals", 5: "score_number",
                 6: "name_chars", 7: "name_min", 8: "date_calendar", 9: "date_format", 10: "course_required"}


@register("generate_students", "SELECT o_orderkey AS row_index, true AS cells_in_range, true AS message_as_expected FROM orders")
def generate_students_q(spark, sf_dir):
    """One generated student per order (seed 42, 5 % corrupted), each held against what the generator promises."""
    rows = generate_students(table(spark, sf_dir, "orders"), "o_orderkey", seed=42, error_rate=0.05)
    domains = "|".join(d.replace(".", "[.]") for d in G.EMAIL_DOMAINS)
    shape = F.col("email").rlike(f"^[a-z]+[.][a-z]+[.][0-9]+@({domains})$")
    own = F.element_at(F.split(F.substring_index("email", "@", 1), "[.]"), -1) == F.col("row_index").cast("string")
    ranges = (F.col("enrollment_date").between(G.DATE_FROM, G.DATE_TO) & F.expr("try_cast(score AS double)").between(0, 100)
              & F.col("course_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$"))
    v = validate(rows.withColumn("line_number", F.col("row_index")), STUDENTS)
    first = F.coalesce(*[F.col(f"{f}_error") for f in STUDENTS.field_names()])
    expected = F.lit(None).cast("string")
    for k, name in _KIND_MESSAGE.items():
        expected = F.when(F.col("corruption") == k, F.lit(R.MSG[name])).otherwise(expected)
    return v.select("row_index", (F.col("corruption").isNotNull() | (shape & own & ranges)).alias("cells_in_range"),
                    first.eqNullSafe(expected).alias("message_as_expected"))


_CORRUPT_BASE = """SELECT o_orderkey AS k, o_orderkey + 2 AS line_number, 'Ana Souza' AS name,
  concat('student.', CAST(o_orderkey AS VARCHAR), '@school.edu') AS email,
  substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS enrollment_date, concat('COURSE-', CAST(o_custkey % 50 AS VARCHAR)) AS course_id,
  concat(CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS VARCHAR), '.', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')) AS score,
  CASE WHEN o_orderkey - 1 - (o_orderkey % 1000) >= 0 THEN concat('student.', CAST(o_orderkey - 1 - (o_orderkey % 1000) AS VARCHAR), '@school.edu') ELSE 'dup@school.edu' END AS dup_email
FROM orders"""

def _cases(values: dict[int, str]) -> str:
    return " ".join(f"WHEN k % 12 = {k} THEN '{v}'" for k, v in values.items())


_CORRUPT_RAW = f"""SELECT line_number, k % 12 AS corruption,
  CASE {_cases(G.CORRUPT_NAME)} ELSE name END AS name,
  CASE WHEN k % 12 = 0 THEN replace(email, '@', '.at.') WHEN k % 12 = 1 THEN '' WHEN k % 12 = 11 THEN dup_email ELSE email END AS email,
  CASE {_cases(G.CORRUPT_DATE)} ELSE enrollment_date END AS enrollment_date,
  CASE WHEN k % 12 = 10 THEN '' ELSE course_id END AS course_id,
  CASE {_cases(G.CORRUPT_SCORE)} ELSE score END AS score
FROM ({_CORRUPT_BASE})"""


@register(
    "corruptions",
    f"""WITH {O.validated_ctes(_CORRUPT_RAW)},
msgs AS (
  SELECT r.corruption, v.name_error, v.email_error, v.date_error, v.course_error, v.score_error
  FROM val v JOIN (SELECT line_number, corruption FROM ({_CORRUPT_RAW})) r ON r.line_number = v.line_number)
SELECT CAST(corruption AS INTEGER) AS corruption, message, CAST(count(*) AS BIGINT) AS rows FROM (
  SELECT corruption, coalesce(name_error, email_error, date_error, course_error, score_error) AS message FROM msgs)
GROUP BY corruption, message""",
)
def corruptions(spark, sf_dir):
    """Corruption k = o_orderkey mod 12 applied to a valid row; first message per row, counted."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    j = k - 1 - (k % 1000)
    base = o.select(
        (k + 2).alias("line_number"),
        (k % 12).cast("int").alias("corruption"),
        F.lit("Ana Souza").alias("name"),
        F.concat(F.lit("student."), k.cast("string"), F.lit("@school.edu")).alias("email"),
        F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("enrollment_date"),
        F.concat(F.lit("COURSE-"), (F.col("o_custkey") % 50).cast("string")).alias("course_id"),
        F.concat((F.floor("o_totalprice").cast("bigint") % 101).cast("string"), F.lit("."),
                 F.lpad((k % 100).cast("string"), 2, "0")).alias("score"),
        F.when(j >= 0, F.concat(F.lit("student."), j.cast("string"), F.lit("@school.edu")))
        .otherwise(F.lit("dup@school.edu")).alias("_dup_email"),
    )
    raw = apply_corruption(base, F.col("corruption"))
    v = validate(raw, STUDENTS)
    first_msg = F.coalesce(*[F.col(f"{f}_error") for f in STUDENTS.field_names()])
    return v.groupBy("corruption", first_msg.alias("message")).agg(F.count("*").cast("bigint").alias("rows"))


@register("first_n_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def first_n_scan(spark, sf_dir):
    """H3: the first n rows in an explicit order (TakeOrderedAndProject)."""
    return table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")

