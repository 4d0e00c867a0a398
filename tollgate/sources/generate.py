"""Synthetic student rows (A11) with one corruption per invalid row.

Every draw is ``xxhash64(seed, row index, draw number)``: order-free and
repeatable, so any task can generate any slice of rows.  The rows carry the
same distributions as the reference's generator (unique emails
``first.last.index@domain``, 50 course ids, dates 2019-01-01..2026-06-30,
scores 0..100 with two decimals, ~error_rate corrupted rows), not the same
bytes.  A duplicate corruption copies the email of a recent row: the row
``index - 1 - (draw mod 1000)``, whose email is recomputed from its own index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.text import slug_latin

# The reference generator's domains, course count and recent-email window.
EMAIL_DOMAINS = ["school.edu", "university.edu.br", "campus.org", "mail.com", "learn.io"]
COURSE_COUNT = 50
RECENT_EMAILS = 1000
DATE_FROM, DATE_TO = "2019-01-01", "2026-06-30"
N_CORRUPTIONS = 12

# Our own name lists (the reference draws names from a faker library).
FIRST_NAMES = ["Ana", "Bruno", "Carla", "Diego", "Elena", "Felipe", "Gabriela", "Hugo", "Inês", "João",
               "Karin", "Lucas", "Marta", "Nuno", "Olga", "Pedro", "Quitéria", "Rafael", "Sofia", "Tomás"]
LAST_NAMES = ["Souza", "Silva", "Costa", "Pereira", "Oliveira", "Santos", "Lima", "Gomes", "Ribeiro", "Almeida",
              "Araújo", "Barbosa", "Cardoso", "Dias", "Fernandes", "Martins", "Nogueira", "O'Neil", "Rocha", "Teixeira"]


def _draw(seed: int, idx: Column, k: int) -> Column:
    return F.xxhash64(F.lit(seed), idx, F.lit(k))


def _pick(values: list[str], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def _unit(h: Column) -> Column:
    """Uniform [0, 1) from a hash."""
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def _email(seed: int, idx: Column) -> Column:
    first, last = _pick(FIRST_NAMES, _draw(seed, idx, 1)), _pick(LAST_NAMES, _draw(seed, idx, 2))
    return F.concat(slug_latin(first), F.lit("."), slug_latin(last), F.lit("."), idx.cast("string"), F.lit("@"),
                    _pick(EMAIL_DOMAINS, _draw(seed, idx, 3)))


def generate_students(index: DataFrame, index_col: str, seed: int = 42, error_rate: float = 0.05) -> DataFrame:
    """One row per ``index_col`` value (a dense 0-based row index).

    Output: row_index, name, email, enrollment_date, course_id, score (all
    text, as in a CSV) and ``corruption`` (0..11, NULL for a valid row).
    """
    idx = F.col(index_col).cast("bigint")
    first, last = _pick(FIRST_NAMES, _draw(seed, idx, 1)), _pick(LAST_NAMES, _draw(seed, idx, 2))
    course_no = F.pmod(_draw(seed, idx, 4), F.lit(COURSE_COUNT))
    u = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.lit(tag), course_no))), 16, "0")
                   for tag in ("course-a", "course-b")])
    course = F.concat_ws("-", F.substring(u, 1, 8), F.substring(u, 9, 4), F.concat(F.lit("4"), F.substring(u, 14, 3)),
                         F.substring(u, 17, 4), F.substring(u, 21, 12))
    span = F.datediff(F.lit(DATE_TO).cast("date"), F.lit(DATE_FROM).cast("date")) + 1
    date = F.date_add(F.lit(DATE_FROM).cast("date"), F.pmod(_draw(seed, idx, 5), span).cast("int"))
    score = F.format_string("%.2f", F.pmod(_draw(seed, idx, 6), F.lit(10001)).cast("double") / 100.0)
    corrupt = _unit(_draw(seed, idx, 7)) < F.lit(error_rate)
    kind = F.when(corrupt, F.pmod(_draw(seed, idx, 8), F.lit(N_CORRUPTIONS)).cast("int"))
    recent = idx - 1 - F.pmod(_draw(seed, idx, 9), F.lit(RECENT_EMAILS))
    dup_email = F.when(recent >= 0, _email(seed, recent)).otherwise(F.lit("dup@school.edu"))
    base = index.select(
        idx.alias("row_index"),
        F.concat_ws(" ", first, last).alias("name"),
        _email(seed, idx).alias("email"),
        date.cast("string").alias("enrollment_date"),
        course.alias("course_id"),
        score.alias("score"),
        kind.alias("corruption"),
        dup_email.alias("_dup_email"),
    )
    return apply_corruption(base, F.col("corruption")).drop("_dup_email")


# What a corrupted cell becomes, by corruption number (the email cases are built from the row).
CORRUPT_SCORE = {0: "48.50", 2: "133.25", 3: "-17", 4: "61.377", 5: "twelve"}
CORRUPT_NAME = {6: "Zo3 Quill", 7: "Q"}
CORRUPT_DATE = {8: "2023-14-41", 9: "07.09.2022"}


def _cells(kind: Column, values: dict[int, str], kept: Column) -> Column:
    out = kept
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def apply_corruption(rows: DataFrame, kind: Column) -> DataFrame:
    """The twelve corruptions, one per invalid row (``kind`` NULL keeps the row)."""
    email = (
        F.when(kind == 0, F.replace(F.col("email"), F.lit("@"), F.lit(".at.")))
        .when(kind == 1, F.lit(""))
        .when(kind == 11, F.col("_dup_email"))
        .otherwise(F.col("email"))
    )
    course = F.when(kind == 10, F.lit("")).otherwise(F.col("course_id"))
    return rows.withColumn("name", _cells(kind, CORRUPT_NAME, F.col("name"))).withColumn("email", email) \
        .withColumn("enrollment_date", _cells(kind, CORRUPT_DATE, F.col("enrollment_date"))) \
        .withColumn("course_id", course).withColumn("score", _cells(kind, CORRUPT_SCORE, F.col("score")))
