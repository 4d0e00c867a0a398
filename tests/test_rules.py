"""Rule vectors (one column rule per table, first failure wins, raw value reported)."""

import pytest
from pyspark.sql import functions as F

from tollgate.functions import rules as R
from tollgate.functions.text import csv_escape
from tollgate.plans.spec import STUDENTS, validate

EMAIL_OK = ["q.ort@lab-7.net", "x@y.zz", "m_k%t@a.b.c.example", "d'arc+77@orte.museum", "\t Q.Ort@LAB-7.NET\n", "k" * 64 + "@tal.ch",
            "w@" + ".".join(["abcdefghi"] * 24) + ".example"]
EMAIL_BAD = ["nothing", "two words@tal.ch", "@tal.ch", "berg@", "berg@tal", "berg@@tal.ch", "berg@tal..ch", "be..rg@tal.ch", "berg.@tal.ch",
             "berg@tal.ch-", "berg@-tal.ch", "b,e@tal.ch"]
NAME_OK = ["Yo", "Ünal Öztürk", "Nuala D'Arcy-Quinn", "Þóra", "n" * 100, "  Iris\u00a0 Holm "]
NAME_BAD = {"": R.MSG["name_required"], "\t\n": R.MSG["name_required"], "Z": R.MSG["name_min"], "n" * 101: R.MSG["name_max"],
            "Iris & Holm": R.MSG["name_chars"], "4711": R.MSG["name_chars"], "Holm!": R.MSG["name_chars"], "''": R.MSG["name_chars"]}
SCORE_OK = {"7": 7.0, "00": 0.0, "100.0": 100.0, "+9.1": 9.1, ".25": 0.25, "\t33.30 ": 33.3, "61.40": 61.4, "99.999999999999": 100.0}
SCORE_BAD = {"-1": R.MSG["score_range"], "100.5": R.MSG["score_range"], "1234": R.MSG["score_range"], "8" * 330: R.MSG["score_range"],
             "3.141": R.MSG["score_decimals"], "0.0049": R.MSG["score_decimals"], "ten": R.MSG["score_number"], "7,5": R.MSG["score_number"],
             "4e1": R.MSG["score_number"], "1.2.3": R.MSG["score_number"], "Infinity": R.MSG["score_number"], "": R.MSG["score_required"]}
DATE_BAD = {"": R.MSG["date_required"], "2021.04.05": R.MSG["date_format"], "5 May 2021": R.MSG["date_format"],
            "2021-02-29": R.MSG["date_calendar"], "2022-00-10": R.MSG["date_calendar"], "2022-06-31": R.MSG["date_calendar"],
            "1850-07-07": R.MSG["date_year"], "2300-07-07": R.MSG["date_year"], "0001-99-99": R.MSG["date_year"], "2100-02-29": R.MSG["date_calendar"]}
COURSE_BAD = {"k" * 37: R.MSG["course_max"], "bio 7": R.MSG["course_chars"], "bio/7": R.MSG["course_chars"], "": R.MSG["course_required"]}


def _errors(spark, field, values):
    base = {"name": "Ana Souza", "email": "a@b.io", "enrollment_date": "2024-02-29", "course_id": "MATH_101-A",
            "score": "50"}
    rows = []
    for i, v in enumerate(values):
        r = dict(base)
        r[field] = v
        rows.append((i, r["name"], r["email"], r["enrollment_date"], r["course_id"], r["score"]))
    df = spark.createDataFrame(rows, "line_number long, name string, email string, enrollment_date string, course_id string, score string")
    out = validate(df, STUDENTS).orderBy("line_number").select(f"{field}_error", f"{field}_value", f"{field}_norm").collect()
    return out


def test_email(spark):
    ok = _errors(spark, "email", EMAIL_OK)
    assert [r[0] for r in ok] == [None] * len(EMAIL_OK)
    assert ok[4][2] == "q.ort@lab-7.net"
    bad = _errors(spark, "email", EMAIL_BAD + ["", "a" * 250 + "@tal.ch", "a" * 65 + "@tal.ch"])
    assert [r[0] for r in bad] == [R.MSG["email_pattern"]] * len(EMAIL_BAD) + [
        R.MSG["email_required"], R.MSG["email_max"], R.MSG["email_local"]]


def test_name(spark):
    assert [r[0] for r in _errors(spark, "name", NAME_OK)] == [None] * len(NAME_OK)
    got = _errors(spark, "name", list(NAME_BAD))
    assert [r[0] for r in got] == list(NAME_BAD.values())
    assert _errors(spark, "name", ["  Maria \t  Clara  "])[0][2] == "Maria Clara"


def test_score(spark):
    got = _errors(spark, "score", list(SCORE_OK))
    assert [r[0] for r in got] == [None] * len(SCORE_OK)
    assert [r[1] for r in got] == list(SCORE_OK.values())
    got = _errors(spark, "score", list(SCORE_BAD))
    assert [r[0] for r in got] == list(SCORE_BAD.values())


def test_date_and_course(spark):
    got = _errors(spark, "enrollment_date", list(DATE_BAD) + ["2024-02-29"])
    assert [r[0] for r in got] == list(DATE_BAD.values()) + [None]
    got = _errors(spark, "course_id", list(COURSE_BAD) + ["MATH_101-A", "123e4567-e89b-12d3-a456-426614174000"])
    assert [r[0] for r in got] == list(COURSE_BAD.values()) + [None, None]


def test_violation_order_and_raw_value(spark):
    df = spark.createDataFrame([(7, "A", " bad ", "24.12.2022", "", "abc")],
                               "line_number long, name string, email string, enrollment_date string, course_id string, score string")
    v = validate(df, STUDENTS).select("violations").collect()[0][0]
    assert [x["field"] for x in v] == ["name", "email", "enrollment_date", "course_id", "score"]
    assert v[1]["value"] == " bad "


@pytest.mark.parametrize("text,expected", [
    ("plain", "plain"), ("42", "42"), ("-3", "-3"), ("85.5", "85.5"), ("a,b", '"a,b"'), ('say "hi"', '"say ""hi"""'),
    ("multi\nline", '"multi\nline"'), ('=HYPERLINK("http://evil")', '"\'=HYPERLINK(""http://evil"")"'),
    ("+SUM(A1)", "'+SUM(A1)"), ("@cmd", "'@cmd"), ("-2+3", "'-2+3"),
])
def test_csv_escape(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(csv_escape(F.col("t"))).collect()[0][0]
    assert got == expected


def test_hard_semantics(spark):
    """Traps listed in SURVEY 7.5: Unicode lowercasing, end anchors, JS whitespace, score edge forms."""
    got = _errors(spark, "email", ["\u212Aate@school.edu", "a@b.io\n", "\u00a0a@b.io\ufeff", "a@b.io\u0085"])
    assert [r[0] for r in got] == [None, None, None, R.MSG["email_pattern"]]
    assert got[0][2] == "kate@school.edu"
    assert got[1][2] == "a@b.io"      # LF is JavaScript whitespace: trimmed
    assert got[2][2] == "a@b.io"      # NBSP and BOM too, U+0085 is not
    got = _errors(spark, "score", ["5.", "-0", "+0.5"])
    assert [r[0] for r in got] == [None, None, None]
    assert [r[1] for r in got] == [5.0, 0.0, 0.5]
    got = _errors(spark, "name", ["Ana\nSouza", "Ana\u0085Souza", "😀😀"])
    assert got[0][0] is None and got[0][2] == "Ana Souza"
    assert got[1][0] == R.MSG["name_chars"]
    assert got[2][0] == R.MSG["name_chars"]  # two emoji: 4 UTF-16 units, but no letters
