"""Registered queries: one per operator, each over the whole driver tables.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE[key] -> SQL``.  The
two sides alias every computed column to the same name.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions import rules as R
from tollgate.operators import report as rep
from tollgate.operators import summary as summ
from tollgate.operators.unique import first_wins
from tollgate.plans import oracle as O
from tollgate.plans.pipeline import DEFAULT_BATCH_SIZE, outcome
from tollgate.plans.spec import STUDENTS, explode_violations, validate, violation_message
from tollgate.sources.fixtures import raw_students, registered, registered_students, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BATCH = DEFAULT_BATCH_SIZE
PROGRESS_INTERVAL = 1000  # 15,000 rows at sf0.01: several snapshots


def register(key: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(raw_students(spark, sf_dir), STUDENTS)


def _outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome(raw_students(spark, sf_dir), registered(spark, sf_dir), BATCH)


# ---- D: rule catalogue -------------------------------------------------------

def _rule_query(field: str, sql_norm: str, sql_raw: str, case_fn) -> None:
    @register(
        f"rule_{field}",
        O.with_validated(f"SELECT line_number, {sql_raw} AS value, {case_fn(sql_norm)} AS message FROM n"),
    )
    def q(spark, sf_dir, _f=field):
        src = "enrollment_date" if _f == "enrollment_date" else _f
        return _validated(spark, sf_dir).select(
            "line_number", F.coalesce(F.col(src), F.lit("")).alias("value"), F.col(f"{_f}_error").alias("message")
        )


_rule_query("name", "name_norm", "name_raw", O.name_case)
_rule_query("email", "email_norm", "email_raw", O.email_case)
_rule_query("enrollment_date", "date_norm", "date_raw", O.date_case)
_rule_query("course_id", "course_norm", "course_raw", O.course_case)
_rule_query("score", "score_norm", "score_raw", O.score_case)


@register(
    "rule_id",
    f"SELECT page_id, url AS value, {O.id_case(O.js_trim('url'))} AS message FROM pages",
)
def rule_id(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    msg = R.first_failure(R.ID_RULES, F.col("url"), R.norm_trim(F.coalesce("url", F.lit(""))))
    return p.select("page_id", F.col("url").alias("value"), msg.alias("message"))


@register("violations", O.with_validated("SELECT line_number, field_ordinal, field, value, message, code FROM viol"))
def violations(spark, sf_dir):
    return explode_violations(_validated(spark, sf_dir), ["line_number"])


@register(
    "violation_message_join",
    O.with_validated(
        "SELECT line_number, string_agg(field || ': ' || message, '; ' ORDER BY field_ordinal) AS message "
        "FROM viol GROUP BY line_number"
    ),
)
def violation_message_join(spark, sf_dir):
    v = _validated(spark, sf_dir).where(~F.col("is_valid"))
    return v.select("line_number", violation_message(F.col("violations")).alias("message"))


@register(
    "accept_reject_split",
    O.with_validated("SELECT line_number, CASE WHEN is_valid THEN 'accepted' ELSE 'rejected' END AS split FROM val"),
)
def accept_reject_split(spark, sf_dir):
    v = _validated(spark, sf_dir)
    acc = v.where(F.col("is_valid")).select("line_number", F.lit("accepted").alias("split"))
    rej = v.where(~F.col("is_valid")).select("line_number", F.lit("rejected").alias("split"))
    return acc.unionByName(rej)


@register(
    "valid_invalid_count",
    O.with_validated(
        "SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN is_valid THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows, "
        "CAST(sum(CASE WHEN is_valid THEN 0 ELSE 1 END) AS BIGINT) AS invalid_rows FROM val"
    ),
)
def valid_invalid_count(spark, sf_dir):
    return summ.valid_invalid_count(_validated(spark, sf_dir))


# ---- C: normalisation ----------------------------------------------------------

@register("norm_email", O.with_validated("SELECT line_number, email_norm AS email FROM n"))
def norm_email(spark, sf_dir):
    return raw_students(spark, sf_dir).select("line_number", R.norm_email(F.coalesce("email", F.lit(""))).alias("email"))


@register("norm_name", O.with_validated("SELECT line_number, name_norm AS name FROM n"))
def norm_name(spark, sf_dir):
    return raw_students(spark, sf_dir).select("line_number", R.norm_name(F.coalesce("name", F.lit(""))).alias("name"))


@register(
    "norm_score",
    O.with_validated(f"SELECT line_number, CASE WHEN score_error IS NULL THEN {O.score_value('score_norm')} END AS score FROM v"),
)
def norm_score(spark, sf_dir):
    return _validated(spark, sf_dir).select("line_number", F.col("score_value").alias("score"))


@register(
    "score_text",
    O.with_validated(
        f"SELECT line_number, printf('%.2f', {O.score_value('score_norm')}) AS score_text FROM v WHERE score_error IS NULL"
    ),
)
def score_text(spark, sf_dir):
    v = _validated(spark, sf_dir).where(F.col("score_error").isNull())
    return v.select("line_number", R.score_text(F.col("score_value")).alias("score_text"))


@register(
    "norm_date",
    O.with_validated("SELECT line_number, CASE WHEN date_error IS NULL THEN CAST(date_norm AS DATE) END AS enrollment_date FROM v"),
)
def norm_date(spark, sf_dir):
    return _validated(spark, sf_dir).select("line_number", F.col("enrollment_date_value").alias("enrollment_date"))


@register("norm_course_id", O.with_validated("SELECT line_number, course_norm AS course_id FROM n"))
def norm_course_id(spark, sf_dir):
    return raw_students(spark, sf_dir).select(
        "line_number", R.norm_trim(F.coalesce("course_id", F.lit(""))).alias("course_id")
    )


@register("norm_id", f"SELECT page_id, {O.js_trim('url')} AS id FROM pages")
def norm_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.norm_trim(F.col("url")).alias("id"))


@register("norm_lookup_key", O.with_validated("SELECT line_number, email_norm AS lookup_key FROM n"))
def norm_lookup_key(spark, sf_dir):
    return raw_students(spark, sf_dir).select(
        "line_number", R.norm_email(F.coalesce("email", F.lit(""))).alias("lookup_key")
    )


@register(
    "date_from_timestamp",
    "SELECT event_id, CASE WHEN ts IS NULL OR year(ts) < 1900 OR year(ts) > 2100 THEN NULL ELSE CAST(ts AS DATE) END AS enrollment_date, "
    f"CASE WHEN ts IS NULL THEN {O.q(R.MSG['date_invalid'])} WHEN year(ts) < 1900 OR year(ts) > 2100 THEN {O.q(R.MSG['date_year'])} END AS message "
    "FROM events",
)
def date_from_timestamp(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    day, msg = R.date_from_timestamp(F.col("ts"))
    return e.select("event_id", day.alias("enrollment_date"), msg.alias("message"))


# ---- E / I: lookups against the registered set ---------------------------------

@register(
    "existing_email_semi",
    O.with_validated(f"SELECT line_number, email_norm AS email FROM val WHERE is_valid AND email_norm IN (SELECT email FROM ({O.REGISTERED}))"),
)
def existing_email_semi(spark, sf_dir):
    v = _validated(spark, sf_dir).where(F.col("is_valid")).select("line_number", F.col("email_value").alias("email"))
    return v.join(registered(spark, sf_dir), on="email", how="left_semi").select("line_number", "email")


@register(
    "new_email_anti",
    O.with_validated(f"SELECT line_number, email_norm AS email FROM val WHERE is_valid AND email_norm NOT IN (SELECT email FROM ({O.REGISTERED}))"),
)
def new_email_anti(spark, sf_dir):
    v = _validated(spark, sf_dir).where(F.col("is_valid")).select("line_number", F.col("email_value").alias("email"))
    return v.join(registered(spark, sf_dir), on="email", how="left_anti").select("line_number", "email")


@register(
    "find_by_email",
    O.with_validated(
        "SELECT n.line_number, t.id, t.email FROM n JOIN (SELECT concat('00000000-0000-7000-8000-', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS id, "
        "concat('user.', CAST(c_custkey AS VARCHAR), '@school.edu') AS email FROM customer WHERE c_custkey % 10 = 0) t ON t.email = n.email_norm"
    ),
)
def find_by_email(spark, sf_dir):
    probes = raw_students(spark, sf_dir).select(
        "line_number", R.norm_email(F.coalesce("email", F.lit(""))).alias("email")
    )
    target = registered_students(spark, sf_dir).select("id", "email")
    # the target's email is unique, so each probe matches at most one row
    return probes.join(target, on="email", how="inner").select("line_number", "id", "email")


@register(
    "distinct_emails",
    O.with_validated(f"SELECT DISTINCT email_norm AS email FROM val WHERE is_valid AND email_norm IN (SELECT email FROM ({O.REGISTERED}))"),
)
def distinct_emails(spark, sf_dir):
    return existing_email_semi(spark, sf_dir).select("email").distinct()


# ---- G / I / H / F: batches, uniqueness, report, counters ------------------------

@register(
    "batch_number",
    O.with_outcome("SELECT line_number, is_valid, batch_no FROM bat2"),
)
def batch_number(spark, sf_dir):
    return _outcome(spark, sf_dir).select("line_number", "is_valid", "batch_no")


@register(
    "batch_sizes",
    O.with_outcome(
        "SELECT batch_no, CAST(count(*) AS BIGINT) AS offered, CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS inserted "
        "FROM oc2 WHERE status <> 'invalid' GROUP BY batch_no"
    ),
)
def batch_sizes(spark, sf_dir):
    return summ.batch_sizes(_outcome(spark, sf_dir))


@register(
    "dedup_first_wins",
    O.with_outcome("SELECT line_number, email_norm AS email FROM val WHERE is_valid AND line_number IN (SELECT first_line FROM firsts)"),
)
def dedup_first_wins(spark, sf_dir):
    v = _validated(spark, sf_dir).where(F.col("is_valid"))
    return first_wins(v).select("line_number", F.col("email_value").alias("email"))


@register(
    "duplicate_reason",
    O.with_outcome("SELECT line_number, email_norm AS email, status AS source, dup_message AS message FROM oc2 WHERE status IN ('existing', 'file')"),
)
def duplicate_reason(spark, sf_dir):
    o = _outcome(spark, sf_dir).where(F.col("status").isin("existing", "file"))
    return o.select("line_number", F.col("email_value").alias("email"), F.col("status").alias("source"),
                    F.col("dup_message").alias("message"))


@register("partition_rows", O.with_outcome("SELECT line_number, status FROM oc2"))
def partition_rows(spark, sf_dir):
    return _outcome(spark, sf_dir).select("line_number", "status")


@register("all_rejections", O.with_outcome("SELECT line_number, field, value, message, code FROM rej"))
def all_rejections(spark, sf_dir):
    return rep.rejections(_outcome(spark, sf_dir)).select("line_number", "field", "value", "message", "code")


@register(
    "report_order",
    O.with_outcome("SELECT batch_no, is_duplicate, line_number, field_ordinal, field, value, message FROM rej"),
)
def report_order(spark, sf_dir):
    r = rep.rejections(_outcome(spark, sf_dir))
    return r.select(*rep.order_key(), "field", "value", "message").orderBy(*rep.order_key())


@register(
    "error_sample",
    O.with_outcome(
        "SELECT line_number, field, value, message FROM rej ORDER BY batch_no, is_duplicate, line_number, field_ordinal LIMIT 100"
    ),
)
def error_sample(spark, sf_dir):
    return rep.error_sample(rep.rejections(_outcome(spark, sf_dir))).select(*rep.REPORT_COLS)


@register(
    "warned_rows",
    O.with_outcome(
        """, rows_ AS (
  SELECT batch_no, 0 AS is_duplicate, line_number, string_agg(field || ': ' || message, '; ' ORDER BY field_ordinal) AS detail
  FROM rej WHERE is_duplicate = 0 GROUP BY batch_no, line_number
  UNION ALL SELECT batch_no, 1, line_number, 'email: ' || message FROM rej WHERE is_duplicate = 1),
top AS (SELECT * FROM rows_ ORDER BY batch_no, is_duplicate, line_number LIMIT 100),
num AS (SELECT CAST(row_number() OVER (ORDER BY batch_no, is_duplicate, line_number) AS BIGINT) AS warn_seq, line_number, detail FROM top)
SELECT * FROM num
UNION ALL SELECT CAST(101 AS BIGINT), CAST(NULL AS BIGINT), 'Further skipped rows are only written to the error report'
FROM (SELECT count(*) AS c FROM num) WHERE c = 100"""
    ),
)
def warned_rows(spark, sf_dir):
    return rep.warned_rows(_outcome(spark, sf_dir))


@register(
    "progress_snapshots",
    O.with_outcome(
        f""", pb AS (
  SELECT batch_no, sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS inserted,
         sum(CASE WHEN status IN ('existing', 'file') THEN 1 ELSE 0 END) AS dups
  FROM oc2 WHERE status <> 'invalid' GROUP BY batch_no),
cum AS (
  SELECT batch_no, sum(inserted) OVER (ORDER BY batch_no) AS ins_c, sum(dups) OVER (ORDER BY batch_no) AS dup_c FROM pb)
SELECT s.row_ordinal AS processed, s.line_number,
  CAST(coalesce(c.ins_c, 0) AS BIGINT) AS imported,
  CAST((s.row_ordinal - s.valid_through) + coalesce(c.dup_c, 0) AS BIGINT) AS errors
FROM bat2 s LEFT JOIN cum c ON c.batch_no = CAST(floor(s.valid_through / {BATCH}) AS BIGINT) - 1
WHERE s.row_ordinal % {PROGRESS_INTERVAL} = 0"""
    ),
)
def progress_snapshots(spark, sf_dir):
    return summ.progress_snapshots(_outcome(spark, sf_dir), BATCH, PROGRESS_INTERVAL)


_SUMMARY_SQL = """SELECT CAST(count(*) AS BIGINT) AS total_processed,
  CAST(sum(CASE WHEN status = 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS total_imported,
  CAST(sum(CASE WHEN status <> 'unique' THEN 1 ELSE 0 END) AS BIGINT) AS total_errors,
  CAST(sum(CASE WHEN status = 'invalid' THEN 1 ELSE 0 END) AS BIGINT) AS invalid_rows,
  CAST(sum(CASE WHEN status = 'existing' THEN 1 ELSE 0 END) AS BIGINT) AS existing_rows,
  CAST(sum(CASE WHEN status = 'file' THEN 1 ELSE 0 END) AS BIGINT) AS file_rows,
  (SELECT CAST(count(*) AS BIGINT) FROM rej) AS report_lines,
  sum(CASE WHEN status <> 'unique' THEN 1 ELSE 0 END) > 0 AS has_error_report
FROM oc2"""


@register("import_summary", O.with_outcome(_SUMMARY_SQL))
def import_summary(spark, sf_dir):
    return summ.import_summary(_outcome(spark, sf_dir))
