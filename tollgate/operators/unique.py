"""Batch numbers, first-occurrence-wins and the duplicate reason as closed forms.

The reference flushes a batch whenever ``batch_size`` valid rows are pending,
looks their emails up in the target, and rejects later copies.  Replayed
sequentially that is a loop; in closed form:

* ``batch_no = floor(valid rows before this row / batch_size)`` for every row
  (invalid rows do not advance the batch) -- a running count (G2);
* an email's first valid occurrence wins unless the email was registered
  before the run (G3);
* a later copy is ``file`` when its first occurrence sits in the same batch and
  ``existing`` otherwise, because by then that first copy was already stored
  (G4).

Skew: per-email facts are computed with ``groupBy(email)`` -- partial
aggregation collapses a hot email map-side -- and joined back on email with
``hot_split_join``: rows of the few heaviest emails join a bounded broadcast
table without shuffling, all others take a normal shuffle join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.functions.rules import MSG
from tollgate.operators.running import running_sums
from pyspark import StorageLevel

from tollgate.operators import skew
from tollgate.operators.skew import hot_keys, hot_split_join

STATUS_INVALID = "invalid"
STATUS_UNIQUE = "unique"
STATUS_EXISTING = "existing"
STATUS_FILE = "file"


def assign_batches(
    df: DataFrame,
    batch_size: int,
    order_col: str = "line_number",
    partition_cols: Sequence[str] = (),
    valid_col: str = "is_valid",
    max_order: int | None = None,
) -> DataFrame:
    """Add ``row_ordinal`` (1-based processed count), ``valid_through``, ``batch_no``."""
    if not isinstance(batch_size, int) or isinstance(batch_size, bool) or not 1 <= batch_size <= 10_000:
        raise ValueError("batch size must be an integer between 1 and 10000")
    staged = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_valid", F.col(valid_col).cast("bigint"))
    # the input is a validated frame (every rule per row): shuffle it once, cached, for all branches
    summed = running_sums(staged, order_col, ["_one", "_valid"], partition_cols, max_order=max_order, persist=True)
    out = (
        summed
        .withColumnRenamed("_one_through", "row_ordinal")
        .withColumnRenamed("_valid_through", "valid_through")
        .withColumn("batch_no", F.floor((F.col("valid_through") - F.col("_valid")) / F.lit(batch_size)).cast("bigint"))
    )
    out = out.drop("_one", "_valid")
    out._tollgate_cached = list(getattr(summed, "_tollgate_cached", []))  # type: ignore[attr-defined]
    return out


def classify(
    batched: DataFrame,
    registered: DataFrame,
    key_col: str = "email_value",
    partition_cols: Sequence[str] = (),
    row_bound: int | None = None,
) -> DataFrame:
    """Add ``status`` in (invalid, unique, existing, file) and ``dup_message``.

    ``row_bound``: an upper bound on the input rows, when known (e.g. lines read);
    at or below the hot-key threshold no key can be hot and the probe is skipped.

    ``registered`` has one column ``email`` (normalised keys stored before the run).
    ``partition_cols`` (e.g. ``file_seq``) make the flush key ``(file_seq, batch_no)``:
    a key first seen in an earlier file counts as already registered.
    """
    parts = list(partition_cols)
    valid = batched.where(F.col("is_valid"))
    invalid = batched.where(~F.col("is_valid"))

    reg = registered.select(F.col("email").alias(key_col)).distinct().withColumn("_registered", F.lit(True))
    firsts = (
        valid.groupBy(key_col)
        .agg(F.min(F.struct(*parts, "line_number", "batch_no")).alias("_first"), F.count("*").alias("_n"))
        .join(reg, on=key_col, how="left")
        .persist(StorageLevel.MEMORY_AND_DISK)  # one narrow row per key: read for hot keys and the join
    )
    hot = [] if row_bound is not None and row_bound <= skew.HOT_ROWS else hot_keys(firsts, key_col)
    joined = hot_split_join(valid, firsts, key_col, hot).drop("_n")

    first = F.col("_first")
    is_first = F.col("line_number") == first["line_number"]
    same_flush = F.col("batch_no") == first["batch_no"]
    for p in parts:
        is_first = is_first & (F.col(p) == first[p])
        same_flush = same_flush & (F.col(p) == first[p])
    status = (
        F.when(F.col("_registered").isNotNull(), F.lit(STATUS_EXISTING))
        .when(is_first, F.lit(STATUS_UNIQUE))
        .when(same_flush, F.lit(STATUS_FILE))
        .otherwise(F.lit(STATUS_EXISTING))
    )
    valid_out = joined.withColumn("status", status).drop("_first", "_registered")
    invalid_out = invalid.withColumn("status", F.lit(STATUS_INVALID))
    out = valid_out.unionByName(invalid_out)
    out = out.withColumn(
        "dup_message",
        F.when(F.col("status") == STATUS_EXISTING, F.lit(MSG["dup_existing"]))
        .when(F.col("status") == STATUS_FILE, F.lit(MSG["dup_file"])),
    )
    out._tollgate_cached = [firsts]  # type: ignore[attr-defined]
    return out


def first_wins(valid: DataFrame, key_col: str = "email_value") -> DataFrame:
    """G3 alone: valid rows that are the first occurrence of their key (line order)."""
    firsts = valid.groupBy(key_col).agg(F.min("line_number").alias("_first_line"), F.count("*").alias("_n"))
    joined = hot_split_join(valid, firsts, key_col, hot_keys(firsts, key_col))
    return joined.where(F.col("line_number") == F.col("_first_line")).drop("_first_line", "_n")
