"""Exact running sums in input order without a single-task window.

The reference's loops carry counters from row to row (valid rows seen so far,
open-quote state, ...).  A window ``ORDER BY line`` without ``PARTITION BY``
would pull the whole input into one task, so the sum is built in three levels:

* rows are grouped into buckets of 2^12 consecutive order values (level 1);
* level-1 buckets into buckets of 2^12 level-1 buckets (level 2, at most
  N / 2^24 rows: about 60,000 even for 10^12 rows);
* exclusive prefix sums flow down: level 2 (one small window), level 1 (window
  per level-2 bucket, <= 4,096 rows each), rows (window per level-1 bucket,
  <= 4,096 rows each, so many buckets keep every core busy).

Buckets depend on the order values only, never on the partition layout, so the
result is repeatable and survives task retries.  Bucket tables are joined back
by equality; AQE broadcasts them when the runtime size allows and otherwise
keeps a shuffle join, whose partitioning the following window reuses.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 12


def running_sums(
    df: DataFrame,
    order_col: str,
    values: Sequence[str],
    partition_cols: Sequence[str] = (),
    suffix: str = "_through",
    max_order: int | None = None,
    persist: bool = False,
) -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over rows with order <= this row's (per partition).

    ``order_col`` must be a non-negative long, unique within ``partition_cols``.
    ``values`` are numeric columns (booleans must be cast by the caller).
    ``max_order``: a known upper bound on ``order_col``; below 2^24 the level-1
    table has at most 4,096 rows per partition key and level 2 is skipped.
    ``persist``: cache the shuffled rows (memory, spilling to disk) when ``df`` is costly to
    recompute.  The bucket tables read only a few columns, so column pruning makes their
    exchange differ from the rows' one and each branch would recompute ``df`` from its source;
    the cache is read by every branch instead and keeps the ``(partition, bucket)``
    partitioning for the join back and the window.  The returned frame lists it in
    ``_tollgate_cached`` for the caller to unpersist.
    """
    parts = list(partition_cols)
    vals = list(values)
    b1 = F.shiftright(F.col(order_col), BUCKET_BITS)

    # one shuffle of the rows by (partition, bucket); with ``persist`` the bucket aggregate,
    # the join back and the per-bucket window all read it (without, column pruning gives
    # the bucket aggregate an exchange of its own)
    rows = df.withColumn("_b1", b1).repartition(*parts, "_b1")
    if persist:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        out = _running(rows, parts, vals, order_col, suffix, max_order)
        out._tollgate_cached = [rows]  # type: ignore[attr-defined]
        return out
    return _running(rows, parts, vals, order_col, suffix, max_order)


def _running(rows: DataFrame, parts: list, vals: list, order_col: str, suffix: str, max_order: int | None) -> DataFrame:
    t1 = rows.groupBy(*parts, "_b1").agg(*[F.sum(v).alias(v) for v in vals])
    if max_order is not None and max_order < (1 << (2 * BUCKET_BITS)):
        w1 = Window.partitionBy(*parts).orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
        t1 = t1.select(*parts, "_b1", *[F.coalesce(F.sum(v).over(w1), F.lit(0)).alias(f"_o1_{v}") for v in vals])
        return _rows_level(rows, t1, order_col, parts, vals, suffix)
    t1 = t1.withColumn("_b2", F.shiftright(F.col("_b1"), BUCKET_BITS))
    t2 = t1.groupBy(*parts, "_b2").agg(*[F.sum(v).alias(v) for v in vals])

    w2 = Window.partitionBy(*parts).orderBy("_b2").rowsBetween(Window.unboundedPreceding, -1)
    t2 = t2.select(
        *parts, "_b2", *[F.coalesce(F.sum(v).over(w2), F.lit(0)).alias(f"_o2_{v}") for v in vals]
    )

    w1 = Window.partitionBy(*parts, "_b2").orderBy("_b1").rowsBetween(Window.unboundedPreceding, -1)
    t1 = t1.join(t2, on=[*parts, "_b2"], how="inner").select(
        *parts,
        "_b1",
        *[(F.col(f"_o2_{v}") + F.coalesce(F.sum(v).over(w1), F.lit(0))).alias(f"_o1_{v}") for v in vals],
    )

    return _rows_level(rows, t1, order_col, parts, vals, suffix)


def _rows_level(rows: DataFrame, t1: DataFrame, order_col: str, parts: list, vals: list, suffix: str) -> DataFrame:
    w0 = Window.partitionBy(*parts, "_b1").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(t1, on=[*parts, "_b1"], how="inner")
    for v in vals:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_o1_{v}") + F.sum(v).over(w0))
    return out.drop("_b1", *[f"_o1_{v}" for v in vals])
