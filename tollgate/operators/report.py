"""Rejections, report order, the bounded samples and the report text.

Report order (G1) is the flush order of the reference: by flush key, then all
invalid rows of that batch (line order, field order), then the batch's
duplicates (line order).  The key is a tuple of columns, so ordering is a
range-partitioned sort -- no single-task window -- and the two bounded samples
are ``orderBy(...).limit(100)``, which Spark plans as TakeOrderedAndProject
(top-k per partition, one small merge).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.rules import CODES
from tollgate.functions.text import csv_escape, csv_line
from tollgate.operators.unique import STATUS_EXISTING, STATUS_FILE, STATUS_INVALID
from tollgate.plans.spec import explode_violations

# Sample sizes and report header of the reference.
MAX_ERRORS_IN_RESULT = 100
MAX_ROW_WARNINGS = 100
REPORT_HEADER = ("line_number", "field", "value", "error_message")
FURTHER_ROWS_NOTICE = "Further skipped rows are only written to the error report"

REPORT_COLS = ["line_number", "field", "value", "message"]


def order_key(partition_cols: Sequence[str] = ()) -> list[str]:
    return [*partition_cols, "batch_no", "is_duplicate", "line_number", "field_ordinal"]


def rejections(outcome: DataFrame, partition_cols: Sequence[str] = (), key_field: str = "email",
               key_ordinal: int = 2) -> DataFrame:
    """Invalid-row violations UNION ALL duplicate violations, with the G1 key columns."""
    parts = list(partition_cols)
    keep = [*parts, "batch_no", "line_number"]
    inv = explode_violations(outcome.where(F.col("status") == STATUS_INVALID), keep).withColumn(
        "is_duplicate", F.lit(0)
    )
    dup = outcome.where(F.col("status").isin(STATUS_EXISTING, STATUS_FILE)).select(
        *keep,
        F.lit(key_ordinal).alias("field_ordinal"),
        F.lit(key_field).alias("field"),
        F.col(f"{key_field}_value").alias("value"),
        F.col("dup_message").alias("message"),
        F.lit(CODES["duplicate"]).alias("code"),
        F.lit(1).alias("is_duplicate"),
    )
    return inv.unionByName(dup)


def error_sample(rej: DataFrame, partition_cols: Sequence[str] = (), n: int = MAX_ERRORS_IN_RESULT) -> DataFrame:
    """H1: the first ``n`` violations in report order."""
    return rej.orderBy(*order_key(partition_cols)).limit(n)


def file_samples(rej: DataFrame, n: int = MAX_ERRORS_IN_RESULT) -> DataFrame:
    """H1 per file: the first ``n`` violations of each file in report order.

    A rank that is bounded per file: every task keeps at most ``n`` rows of a file before the
    shuffle, so neither a global sort nor a file with most of the rows meets one task.
    """
    w = Window.partitionBy("file_seq").orderBy(*order_key())
    return rej.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def file_warnings(rej: DataFrame, n: int = MAX_ROW_WARNINGS) -> DataFrame:
    """H2 per file: the first ``n`` rejected rows of each file with their ``field: message`` list."""
    keys = ["file_seq", "batch_no", "is_duplicate", "line_number"]
    # n violations of distinct rows need more than n violations, so rows are ranked, not violations
    w = Window.partitionBy("file_seq").orderBy(*keys[1:])
    rows = rej.withColumn("_rank", F.dense_rank().over(w)).where(F.col("_rank") <= n)
    detail = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field_ordinal", "field", "message"))),
                                      lambda v: F.concat(v["field"], F.lit(": "), v["message"])), "; ")
    return rows.groupBy(*keys, "_rank").agg(detail.alias("detail")).select(
        "file_seq", F.col("_rank").cast("bigint").alias("warn_seq"), "line_number", "detail")


def warned_rows(outcome: DataFrame, partition_cols: Sequence[str] = (), n: int = MAX_ROW_WARNINGS) -> DataFrame:
    """H2: the first ``n`` rejected rows with their ``field: message`` list, then the notice.

    Output: ``warn_seq`` (1..n, n+1 for the notice), ``line_number``, ``detail``.
    """
    parts = list(partition_cols)
    keys = [*parts, "batch_no", "is_duplicate", "line_number"]
    rejected = outcome.where(F.col("status") != "unique").select(
        *parts,
        "batch_no",
        F.when(F.col("status") == STATUS_INVALID, 0).otherwise(1).alias("is_duplicate"),
        "line_number",
        "status",
        "violations",
        "dup_message",
    )
    # top-k first (TakeOrderedAndProject), then the text of the <= n rows kept
    top = rejected.orderBy(*keys).limit(n)
    numbered = top.select(
        F.row_number().over(Window.orderBy(*keys)).cast("bigint").alias("warn_seq"),
        "line_number",
        F.when(
            F.col("status") == STATUS_INVALID,
            F.array_join(F.transform("violations", lambda v: F.concat(v["field"], F.lit(": "), v["message"])), "; "),
        ).otherwise(F.concat(F.lit("email: "), F.col("dup_message"))).alias("detail"),
    )
    notice = (
        numbered.agg(F.count("*").alias("c"))
        .where(F.col("c") == n)
        .select(F.lit(n + 1).cast("bigint").alias("warn_seq"), F.lit(None).cast("bigint").alias("line_number"),
                F.lit(FURTHER_ROWS_NOTICE).alias("detail"))
    )
    return numbered.unionByName(notice)


def report_text(rej: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """B3 + C9 + C10: one escaped CSV line per rejected field, with its order key."""
    return rej.select(
        *order_key(partition_cols),
        csv_line(
            F.col("line_number").cast("string"),
            csv_escape(F.col("field")),
            csv_escape(F.coalesce(F.col("value"), F.lit(""))),
            csv_escape(F.col("message")),
        ).alias("line"),
    )
