"""Counters: import summary, batch sizes, progress snapshots, rate rounding.

All of them are aggregations over the outcome frame; the driver only ever
receives one row per batch or per snapshot, never per input row.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.running import running_sums
from tollgate.operators.unique import STATUS_EXISTING, STATUS_FILE, STATUS_INVALID, STATUS_UNIQUE

# Fixed value: progress is logged every 10,000 processed rows in the reference.
PROGRESS_LOG_INTERVAL = 10_000


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def import_summary(outcome: DataFrame) -> DataFrame:
    """processed / imported / rejected rows (not fields) and the report size."""
    st = F.col("status")
    return outcome.agg(
        F.count("*").cast("bigint").alias("total_processed"),
        _count_if(st == STATUS_UNIQUE).alias("total_imported"),
        _count_if(st != STATUS_UNIQUE).alias("total_errors"),
        _count_if(st == STATUS_INVALID).alias("invalid_rows"),
        _count_if(st == STATUS_EXISTING).alias("existing_rows"),
        _count_if(st == STATUS_FILE).alias("file_rows"),
        F.sum(F.when(st == STATUS_INVALID, F.size("violations")).when(st != STATUS_UNIQUE, 1).otherwise(0))
        .cast("bigint").alias("report_lines"),
    ).select(
        "*",
        (F.col("total_errors") > 0).alias("has_error_report"),
    )


def valid_invalid_count(validated: DataFrame) -> DataFrame:
    """rows, valid and invalid without the uniqueness check."""
    return validated.agg(
        F.count("*").cast("bigint").alias("total_rows"),
        _count_if(F.col("is_valid")).alias("valid_rows"),
        _count_if(~F.col("is_valid")).alias("invalid_rows"),
    )


def batch_sizes(outcome: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """rows offered (valid) and inserted (unique) per flushed batch."""
    return (
        outcome.where(F.col("status") != STATUS_INVALID)
        .groupBy(*partition_cols, "batch_no")
        .agg(F.count("*").cast("bigint").alias("offered"), _count_if(F.col("status") == STATUS_UNIQUE).alias("inserted"))
    )


def progress_snapshots(outcome: DataFrame, batch_size: int, interval: int = PROGRESS_LOG_INTERVAL) -> DataFrame:
    """Counters at every ``interval``-th processed row.

    After row N the batches ``b < floor(valid_through_N / batch_size)`` are
    flushed; pending valid rows count neither as imported nor as errors.
    ``outcome`` must carry ``row_ordinal`` and ``valid_through`` (single input).
    """
    snaps = outcome.where(F.col("row_ordinal") % interval == 0).select(
        F.col("row_ordinal").alias("processed"),
        F.col("line_number"),
        (F.col("row_ordinal") - F.col("valid_through")).alias("invalid_through"),
        (F.floor(F.col("valid_through") / F.lit(batch_size)).cast("bigint") - 1).alias("last_flushed"),
    )
    per_batch = (
        batch_sizes(outcome)
        .withColumn("dups", F.col("offered") - F.col("inserted"))
        .select("batch_no", "inserted", "dups")
    )
    cum = running_sums(per_batch, "batch_no", ["inserted", "dups"]).select(
        F.col("batch_no").alias("last_flushed"), "inserted_through", "dups_through"
    )
    return snaps.join(cum, on="last_flushed", how="left").select(
        "processed",
        "line_number",
        F.coalesce("inserted_through", F.lit(0)).cast("bigint").alias("imported"),
        (F.col("invalid_through") + F.coalesce("dups_through", F.lit(0))).cast("bigint").alias("errors"),
    )


def rate(rows: Column, elapsed_ms: Column) -> Column:
    """Rows per second, ``rows`` when no time elapsed (JavaScript Math.round)."""
    return F.when(elapsed_ms > 0, F.floor(rows * 1000.0 / elapsed_ms + 0.5)).otherwise(rows).cast("bigint")


def round1(x: Column) -> Column:
    """One decimal, half up."""
    return F.floor(x * 10.0 + 0.5) / 10.0
