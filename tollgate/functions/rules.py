"""Field rules as ordered (predicate, message) lists over Column expressions.

A field's rules are tried in order and only the first failing one is reported,
so each field compiles to a single ``CASE WHEN`` chain: later (more expensive)
checks such as regexes only run once the cheap length checks passed.  Casts are
``try_cast`` because ANSI mode would otherwise raise on the first bad cell.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tollgate.functions.text import collapse_ws, js_trim, utf16_length

# Rule messages, limits, patterns and error codes of the student
# data set.  They must equal the reference's text byte for byte.
NAME_MIN, NAME_MAX = 2, 100
EMAIL_MAX, EMAIL_LOCAL_MAX = 255, 64
ID_MAX, COURSE_ID_MAX = 36, 36
YEAR_MIN, YEAR_MAX = 1900, 2100
SCORE_MIN, SCORE_MAX = 0, 100
SCORE_DECIMALS = 2
FLOAT_TOLERANCE = 1e-9

NAME_ALLOWED = r"^[\p{L}\p{M} '’-]+\z"
NAME_HAS_LETTER = r"\p{L}"
EMAIL_PATTERN = (
    r"^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)+\z"
)
ISO_DATE = r"^\d{4}-\d{2}-\d{2}\z"
COURSE_ID_PATTERN = r"^[A-Za-z0-9_-]+\z"
DECIMAL_NOTATION = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)\z"

MSG = {
    "id_required": "Id is required",
    "id_max": "Id must be at most 36 characters",
    "name_required": "Name is required",
    "name_min": "Name must be at least 2 characters",
    "name_max": "Name must be at most 100 characters",
    "name_chars": "Name may only contain letters, spaces, hyphens and apostrophes",
    "email_required": "Email is required",
    "email_max": "Email must be at most 255 characters",
    "email_pattern": "Email must be a valid address",
    "email_local": "Email local part must be at most 64 characters",
    "date_required": "Enrollment date is required",
    "date_format": "Enrollment date must use the YYYY-MM-DD format",
    "date_year": "Enrollment year must be between 1900 and 2100",
    "date_calendar": "Enrollment date is not a valid calendar date",
    "date_invalid": "Enrollment date is invalid",
    "course_required": "Course id is required",
    "course_max": "Course id must be at most 36 characters",
    "course_chars": "Course id may only contain letters, digits, hyphens and underscores",
    "score_required": "Score is required",
    "score_number": "Score must be a number",
    "score_range": "Score must be between 0 and 100",
    "score_decimals": "Score must have at most 2 decimal places",
    "dup_existing": "A student with this email is already registered",
    "dup_file": "Email appears more than once in the file",
}

CODES = {
    "id": "INVALID_STUDENT_ID",
    "name": "INVALID_STUDENT_NAME",
    "email": "INVALID_EMAIL",
    "enrollment_date": "INVALID_ENROLLMENT_DATE",
    "course_id": "INVALID_COURSE_ID",
    "score": "INVALID_SCORE",
    "duplicate": "DUPLICATE_STUDENT",
}


@dataclass(frozen=True)
class Rule:
    """``fails(raw, norm)`` is true when the rule is broken; ``message`` is reported."""

    message: str
    fails: Callable[[Column, Column], Column]


def first_failure(rules: tuple[Rule, ...], raw: Column, norm: Column) -> Column:
    """Message of the first broken rule, or NULL when the field is valid."""
    expr = None
    for rule in rules:
        cond = F.coalesce(rule.fails(raw, norm), F.lit(False))
        expr = F.when(cond, F.lit(rule.message)) if expr is None else expr.when(cond, F.lit(rule.message))
    return expr.otherwise(F.lit(None).cast("string"))


# ---- normalisers (C1-C4, C6) -------------------------------------------------

def norm_email(raw: Column) -> Column:
    return F.lower(js_trim(raw))


def norm_name(raw: Column) -> Column:
    return collapse_ws(raw)


def norm_trim(raw: Column) -> Column:
    return js_trim(raw)


def _try_double(c: Column) -> Column:
    """Parsed score as double; only meaningful once the decimal pattern matched."""
    return c.try_cast("double")


def _try_date(c: Column) -> Column:
    return c.try_cast("date")


def score_scaled(trimmed: Column) -> Column:
    return _try_double(trimmed) * F.lit(10.0 ** SCORE_DECIMALS)


def score_rounded(trimmed: Column) -> Column:
    # JavaScript Math.round: floor(x + 0.5)
    return F.floor(score_scaled(trimmed) + F.lit(0.5)).cast("double")


def score_value(trimmed: Column) -> Column:
    """The normalised score (double, two decimals)."""
    return score_rounded(trimmed) / F.lit(10.0 ** SCORE_DECIMALS)


def score_text(value: Column) -> Column:
    """Fixed two decimals, e.g. 7.5 -> '7.50'."""
    return F.format_string("%.2f", value)


# ---- rule lists (D1-D6) ------------------------------------------------------

_LENGTH: list[Column] = []


class known_length:
    """Within this block, rules reuse an already computed length column of the field."""

    def __init__(self, col: Column):
        self.col = col

    def __enter__(self):
        _LENGTH.append(self.col)

    def __exit__(self, *exc):
        _LENGTH.pop()


def _len(c: Column) -> Column:
    return _LENGTH[-1] if _LENGTH else utf16_length(c)


ID_RULES = (
    Rule(MSG["id_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["id_max"], lambda raw, n: _len(n) > ID_MAX),
)

NAME_RULES = (
    Rule(MSG["name_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["name_min"], lambda raw, n: _len(n) < NAME_MIN),
    Rule(MSG["name_max"], lambda raw, n: _len(n) > NAME_MAX),
    Rule(MSG["name_chars"], lambda raw, n: ~n.rlike(NAME_ALLOWED) | ~n.rlike(NAME_HAS_LETTER)),
)

EMAIL_RULES = (
    Rule(MSG["email_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["email_max"], lambda raw, n: _len(n) > EMAIL_MAX),
    Rule(MSG["email_pattern"], lambda raw, n: ~n.rlike(EMAIL_PATTERN)),
    # the pattern admits exactly one '@' and only ASCII, so the local part is
    # everything before it and its character count is its UTF-16 length
    Rule(MSG["email_local"], lambda raw, n: F.length(F.substring_index(n, "@", 1)) > EMAIL_LOCAL_MAX),
)

DATE_RULES = (
    Rule(MSG["date_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["date_format"], lambda raw, n: ~n.rlike(ISO_DATE)),
    Rule(
        MSG["date_year"],
        lambda raw, n: (F.substring(n, 1, 4).cast("int") < YEAR_MIN) | (F.substring(n, 1, 4).cast("int") > YEAR_MAX),
    ),
    Rule(MSG["date_calendar"], lambda raw, n: _try_date(n).isNull()),
)

COURSE_RULES = (
    Rule(MSG["course_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["course_max"], lambda raw, n: _len(n) > COURSE_ID_MAX),
    Rule(MSG["course_chars"], lambda raw, n: ~n.rlike(COURSE_ID_PATTERN)),
)


def _decimals_broken(n: Column) -> Column:
    scaled = score_scaled(n)
    rounded = F.floor(scaled + F.lit(0.5)).cast("double")
    return F.abs(scaled - rounded) > F.lit(FLOAT_TOLERANCE) * F.greatest(F.lit(1.0), F.abs(scaled))


SCORE_RULES = (
    Rule(MSG["score_required"], lambda raw, n: _len(n) == 0),
    Rule(MSG["score_number"], lambda raw, n: ~n.rlike(DECIMAL_NOTATION)),
    Rule(
        MSG["score_range"],
        lambda raw, n: (_try_double(n) < SCORE_MIN) | (_try_double(n) > SCORE_MAX),
    ),
    Rule(MSG["score_decimals"], lambda raw, n: _decimals_broken(n)),
)


def date_from_timestamp(ts: Column) -> tuple[Column, Column]:
    """A timestamp is cut to its UTC day and range-checked.

    Returns ``(day, message)``; a NULL timestamp stands for an invalid one.
    """
    day = F.to_date(ts)
    year = F.year(day)
    msg = (
        F.when(ts.isNull(), F.lit(MSG["date_invalid"]))
        .when((year < YEAR_MIN) | (year > YEAR_MAX), F.lit(MSG["date_year"]))
        .otherwise(F.lit(None).cast("string"))
    )
    return F.when(msg.isNull(), day), msg
