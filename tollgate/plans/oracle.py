"""Reference SQL (DuckDB dialect) for each registered query.

These strings restate the rules as plain SQL ``CASE`` chains and ordered
window sums over the whole tables, so the Spark plans can be checked against
an independent engine.  Patterns come from the same fixed constants as the
Spark expressions; single quotes are doubled for SQL literals.
"""

from __future__ import annotations

from tollgate.functions import rules as R
from tollgate.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(T.JS_TRIM_PATTERN)}, '', 'g')"


def collapse(x: str) -> str:
    return f"regexp_replace({js_trim(x)}, {q(T.JS_WS + '+')}, ' ', 'g')"


def u16len(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


RAW_STUDENTS = """SELECT o_orderkey + 2 AS line_number,
 CASE WHEN o_orderkey % 41 = 0 THEN 'M4rit Lund' WHEN o_orderkey % 43 = 0 THEN 'Q' WHEN o_orderkey % 47 = 0 THEN '  Edda   Brandt '
      WHEN o_orderkey % 101 = 0 THEN '' WHEN o_orderkey % 103 = 0 THEN repeat('Ab ', 40) ELSE 'Nuala Quinn' END AS name,
 CASE WHEN o_orderkey % 31 = 0 THEN concat('user.at.', CAST(o_orderkey AS VARCHAR)) WHEN o_orderkey % 37 = 0 THEN ''
      WHEN o_orderkey % 107 = 0 THEN concat(repeat('long.', 12), CAST(o_orderkey AS VARCHAR), '@', repeat('part.', 50), 'edu')
      WHEN o_orderkey % 109 = 0 THEN concat(repeat('l', 70), CAST(o_orderkey AS VARCHAR), '@school.edu')
      ELSE concat(' User.', CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE 100000 + o_orderkey END AS VARCHAR), '@School.EDU') END AS email,
 CASE WHEN o_orderkey % 53 = 0 THEN '2024-02-30' WHEN o_orderkey % 59 = 0 THEN '24.12.2022' WHEN o_orderkey % 61 = 0 THEN '1899-12-31' ELSE substr(CAST(o_orderdate AS VARCHAR), 1, 10) END AS enrollment_date,
 CASE WHEN o_orderkey % 67 = 0 THEN '' WHEN o_orderkey % 71 = 0 THEN 'course 101' WHEN o_orderkey % 113 = 0 THEN repeat('ROOM-', 8) ELSE concat('COURSE-', CAST(o_custkey % 50 AS VARCHAR)) END AS course_id,
 CASE WHEN o_orderkey % 73 = 0 THEN 'twelve' WHEN o_orderkey % 79 = 0 THEN '61.377' WHEN o_orderkey % 83 = 0 THEN '-17'
      ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS VARCHAR), '.', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')) END AS score
FROM orders"""

REGISTERED = "SELECT concat('user.', CAST(c_custkey AS VARCHAR), '@school.edu') AS email FROM customer WHERE c_custkey % 10 = 0"


def name_case(n: str) -> str:
    L = u16len(n)
    return (
        f"CASE WHEN {L} = 0 THEN {q(R.MSG['name_required'])} WHEN {L} < {R.NAME_MIN} THEN {q(R.MSG['name_min'])} "
        f"WHEN {L} > {R.NAME_MAX} THEN {q(R.MSG['name_max'])} "
        f"WHEN NOT {rx(n, R.NAME_ALLOWED)} OR NOT {rx(n, R.NAME_HAS_LETTER)} THEN {q(R.MSG['name_chars'])} END"
    )


def email_case(n: str) -> str:
    L = u16len(n)
    return (
        f"CASE WHEN {L} = 0 THEN {q(R.MSG['email_required'])} WHEN {L} > {R.EMAIL_MAX} THEN {q(R.MSG['email_max'])} "
        f"WHEN NOT {rx(n, R.EMAIL_PATTERN)} THEN {q(R.MSG['email_pattern'])} "
        f"WHEN length(split_part({n}, '@', 1)) > {R.EMAIL_LOCAL_MAX} THEN {q(R.MSG['email_local'])} END"
    )


def date_case(n: str) -> str:
    L = u16len(n)
    y = f"TRY_CAST(substr({n}, 1, 4) AS INTEGER)"
    return (
        f"CASE WHEN {L} = 0 THEN {q(R.MSG['date_required'])} WHEN NOT {rx(n, R.ISO_DATE)} THEN {q(R.MSG['date_format'])} "
        f"WHEN {y} < {R.YEAR_MIN} OR {y} > {R.YEAR_MAX} THEN {q(R.MSG['date_year'])} "
        f"WHEN TRY_CAST({n} AS DATE) IS NULL THEN {q(R.MSG['date_calendar'])} END"
    )


def course_case(n: str) -> str:
    L = u16len(n)
    return (
        f"CASE WHEN {L} = 0 THEN {q(R.MSG['course_required'])} WHEN {L} > {R.COURSE_ID_MAX} THEN {q(R.MSG['course_max'])} "
        f"WHEN NOT {rx(n, R.COURSE_ID_PATTERN)} THEN {q(R.MSG['course_chars'])} END"
    )


def score_case(n: str) -> str:
    L = u16len(n)
    x = f"TRY_CAST({n} AS DOUBLE)"
    s = f"({x} * 100.0)"
    return (
        f"CASE WHEN {L} = 0 THEN {q(R.MSG['score_required'])} WHEN NOT {rx(n, R.DECIMAL_NOTATION)} THEN {q(R.MSG['score_number'])} "
        f"WHEN {x} < 0 OR {x} > 100 THEN {q(R.MSG['score_range'])} "
        f"WHEN abs({s} - floor({s} + 0.5)) > 1e-9 * greatest(1.0, abs({s})) THEN {q(R.MSG['score_decimals'])} END"
    )


def id_case(n: str) -> str:
    L = u16len(n)
    return f"CASE WHEN {L} = 0 THEN {q(R.MSG['id_required'])} WHEN {L} > {R.ID_MAX} THEN {q(R.MSG['id_max'])} END"


def score_value(n: str) -> str:
    return f"(floor(TRY_CAST({n} AS DOUBLE) * 100.0 + 0.5) / 100.0)"


# Validated rows: raw cells, normalised cells, per-field messages, is_valid.
def validated_ctes(raw_sql: str, extra: str = "") -> str:
    return VALIDATED_TEMPLATE.replace("@RAW@", raw_sql).replace("@EXTRA@", extra)


VALIDATED_TEMPLATE = f"""raw AS (@RAW@),
n AS (
  SELECT line_number@EXTRA@,
    coalesce(name, '') AS name_raw, coalesce(email, '') AS email_raw, coalesce(enrollment_date, '') AS date_raw,
    coalesce(course_id, '') AS course_raw, coalesce(score, '') AS score_raw,
    {collapse("coalesce(name, '')")} AS name_norm,
    lower({js_trim("coalesce(email, '')")}) AS email_norm,
    {js_trim("coalesce(enrollment_date, '')")} AS date_norm,
    {js_trim("coalesce(course_id, '')")} AS course_norm,
    {js_trim("coalesce(score, '')")} AS score_norm
  FROM raw),
v AS (
  SELECT *, {name_case('name_norm')} AS name_error, {email_case('email_norm')} AS email_error,
    {date_case('date_norm')} AS date_error, {course_case('course_norm')} AS course_error,
    {score_case('score_norm')} AS score_error
  FROM n),
val AS (
  SELECT *, (name_error IS NULL AND email_error IS NULL AND date_error IS NULL AND course_error IS NULL
             AND score_error IS NULL) AS is_valid
  FROM v)"""
VALIDATED = validated_ctes(RAW_STUDENTS)

# One row per violation (field order name=1 .. score=5).
VIOLATIONS = """viol AS (
  SELECT line_number, 1 AS field_ordinal, 'name' AS field, name_raw AS value, name_error AS message, 'INVALID_STUDENT_NAME' AS code FROM val WHERE name_error IS NOT NULL
  UNION ALL SELECT line_number, 2, 'email', email_raw, email_error, 'INVALID_EMAIL' FROM val WHERE email_error IS NOT NULL
  UNION ALL SELECT line_number, 3, 'enrollment_date', date_raw, date_error, 'INVALID_ENROLLMENT_DATE' FROM val WHERE date_error IS NOT NULL
  UNION ALL SELECT line_number, 4, 'course_id', course_raw, course_error, 'INVALID_COURSE_ID' FROM val WHERE course_error IS NOT NULL
  UNION ALL SELECT line_number, 5, 'score', score_raw, score_error, 'INVALID_SCORE' FROM val WHERE score_error IS NOT NULL)"""


def outcome_ctes(batch_size: int = 1000, raw_sql: str | None = None) -> str:
    """Batch numbers by an ordered window sum, first occurrence and status."""
    validated = VALIDATED if raw_sql is None else validated_ctes(raw_sql)
    return f"""{validated},
{VIOLATIONS},
bat AS (
  SELECT *, row_number() OVER (ORDER BY line_number) AS row_ordinal,
    sum(CASE WHEN is_valid THEN 1 ELSE 0 END) OVER (ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS valid_through
  FROM val),
bat2 AS (
  SELECT *, CAST(floor((valid_through - CASE WHEN is_valid THEN 1 ELSE 0 END) / {batch_size}) AS BIGINT) AS batch_no FROM bat),
reg AS (SELECT DISTINCT email FROM ({REGISTERED})),
firsts AS (
  SELECT email_norm, min(line_number) AS first_line, min(batch_no) AS first_batch FROM bat2 WHERE is_valid GROUP BY email_norm),
oc AS (
  SELECT b.*,
    CASE WHEN NOT b.is_valid THEN 'invalid'
         WHEN r.email IS NOT NULL THEN 'existing'
         WHEN b.line_number = f.first_line THEN 'unique'
         WHEN b.batch_no = f.first_batch THEN 'file'
         ELSE 'existing' END AS status
  FROM bat2 b LEFT JOIN firsts f ON b.is_valid AND b.email_norm = f.email_norm
  LEFT JOIN reg r ON b.is_valid AND b.email_norm = r.email),
oc2 AS (
  SELECT *, CASE WHEN status = 'existing' THEN {q(R.MSG['dup_existing'])} WHEN status = 'file' THEN {q(R.MSG['dup_file'])} END AS dup_message FROM oc),
rej AS (
  SELECT o.batch_no, 0 AS is_duplicate, v.line_number, v.field_ordinal, v.field, v.value, v.message, v.code
  FROM viol v JOIN oc2 o ON o.line_number = v.line_number
  UNION ALL
  SELECT batch_no, 1, line_number, 2, 'email', email_norm, dup_message, 'DUPLICATE_STUDENT' FROM oc2 WHERE status IN ('existing', 'file'))"""


def with_outcome(select: str, batch_size: int = 1000, raw_sql: str | None = None) -> str:
    return f"WITH {outcome_ctes(batch_size, raw_sql)}\n{select}"


def with_validated(select: str) -> str:
    return f"WITH {VALIDATED},\n{VIOLATIONS}\n{select}"


def files_outcome_ctes(raw_sql: str, batch_size: int = 1000) -> str:
    """Outcome over several files imported in file order: flush key (file_seq, batch_no)."""
    return f"""{validated_ctes(raw_sql, ", file_seq")},
{VIOLATIONS},
bat AS (
  SELECT *, sum(CASE WHEN is_valid THEN 1 ELSE 0 END) OVER (PARTITION BY file_seq ORDER BY line_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS valid_through
  FROM val),
bat2 AS (
  SELECT *, CAST(floor((valid_through - CASE WHEN is_valid THEN 1 ELSE 0 END) / {batch_size}) AS BIGINT) AS batch_no,
    CAST(file_seq AS BIGINT) * 10000000000 + line_number AS ord FROM bat),
reg AS (SELECT DISTINCT email FROM ({REGISTERED})),
firsts AS (
  SELECT email_norm, min(ord) AS first_ord, arg_min(batch_no, ord) AS first_batch, arg_min(file_seq, ord) AS first_file
  FROM bat2 WHERE is_valid GROUP BY email_norm),
oc2 AS (
  SELECT b.*,
    CASE WHEN NOT b.is_valid THEN 'invalid'
         WHEN r.email IS NOT NULL THEN 'existing'
         WHEN b.ord = f.first_ord THEN 'unique'
         WHEN b.file_seq = f.first_file AND b.batch_no = f.first_batch THEN 'file'
         ELSE 'existing' END AS status
  FROM bat2 b LEFT JOIN firsts f ON b.is_valid AND b.email_norm = f.email_norm
  LEFT JOIN reg r ON b.is_valid AND b.email_norm = r.email)"""
