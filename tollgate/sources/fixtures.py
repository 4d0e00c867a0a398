"""Inputs derived from the driver tables.

``raw_students`` turns every ``orders`` row into one untrusted CSV-like record
(line number = ``o_orderkey + 2``, the header being line 1), with corruptions
chosen by key residues so every rule fires.  ``registered`` is the set of
emails already stored in the target before a run.  Both are plain projections:
their size grows with the tables and Catalyst prunes the scans to the columns
used.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_COLUMNS = ["line_number", "name", "email", "enrollment_date", "course_id", "score"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input that arrived in fewer splits than the cluster has cores.

    A small single-row-group file is one split; a large input already has
    plenty of splits and is left alone (no extra shuffle).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_students(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    name = (
        F.when(k % 41 == 0, "M4rit Lund").when(k % 43 == 0, "Q").when(k % 47 == 0, "  Edda   Brandt ")
        .when(k % 101 == 0, "").when(k % 103 == 0, F.repeat(F.lit("Ab "), 40))
        .otherwise("Nuala Quinn")
    )
    email = (
        F.when(k % 31 == 0, F.concat(F.lit("user.at."), s(k)))
        .when(k % 37 == 0, F.lit(""))
        .when(k % 107 == 0, F.concat(F.repeat(F.lit("long."), 12), s(k), F.lit("@"), F.repeat(F.lit("part."), 50), F.lit("edu")))
        .when(k % 109 == 0, F.concat(F.repeat(F.lit("l"), 70), s(k), F.lit("@school.edu")))
        .otherwise(F.concat(F.lit(" User."), s(F.when(k % 5 == 0, F.col("o_custkey")).otherwise(100000 + k)),
                            F.lit("@School.EDU")))
    )
    date = (
        F.when(k % 53 == 0, "2024-02-30").when(k % 59 == 0, "24.12.2022").when(k % 61 == 0, "1899-12-31")
        .otherwise(F.substring(s(F.col("o_orderdate")), 1, 10))
    )
    course = (
        F.when(k % 67 == 0, "").when(k % 71 == 0, "course 101").when(k % 113 == 0, F.repeat(F.lit("ROOM-"), 8))
        .otherwise(F.concat(F.lit("COURSE-"), s(F.col("o_custkey") % 50)))
    )
    score = (
        F.when(k % 73 == 0, "twelve").when(k % 79 == 0, "61.377").when(k % 83 == 0, "-17")
        .otherwise(F.concat(s(F.floor(F.col("o_totalprice")).cast("bigint") % 101), F.lit("."),
                            F.lpad(s(k % 100), 2, "0")))
    )
    return o.select(
        (k + 2).alias("line_number"),
        name.alias("name"),
        email.alias("email"),
        date.alias("enrollment_date"),
        course.alias("course_id"),
        score.alias("score"),
    )


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails stored in the target before the run (every tenth customer)."""
    c = table(spark, sf_dir, "customer")
    return c.where(F.col("c_custkey") % 10 == 0).select(
        F.concat(F.lit("user."), F.col("c_custkey").cast("string"), F.lit("@school.edu")).alias("email")
    )


def registered_students(spark: SparkSession, sf_dir: str, every: int = 10) -> DataFrame:
    """The same registered set as full target rows (students schema); names are ``c_name``.

    ``every=1``: one row per customer.
    """
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.where(k % every == 0).select(
        F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(k.cast("string"), 12, "0")).alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("user."), k.cast("string"), F.lit("@school.edu")).alias("email"),
        F.lit("2024-02-01").cast("date").alias("enrollment_date"),
        F.concat(F.lit("COURSE-"), (k % 50).cast("string")).alias("course_id"),
        F.pmod(F.floor(F.col("c_acctbal")), F.lit(101)).cast("double").alias("score"),
    )
