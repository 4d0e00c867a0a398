"""Places of turns within their conversations, whatever the size of one conversation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tollgate.llm.common import bound_batches, column, fresh, written


def pair_hash(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes of several columns."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))]


def numbered(rows: DataFrame, group: str, order: list[str], place: str = "place") -> DataFrame:
    """``rows``, written, with their place from 0 within ``group`` (long, null is a group) by ``order``, nulls first.

    The rows are sorted over all tasks, ranges of (group, order) to each, so that a group of any
    size spreads; equal rows are told apart by where they were read, so that they spread as well.
    A task counts along its rows, and what a group has in earlier tasks (a row per task at most)
    is added afterwards.
    """
    last = fresh("_read", rows)
    by = [F.col(c).asc_nulls_first() for c in [group, *order, last]]
    ranged = rows.withColumn(last, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop(last)
    bound_batches(rows.sparkSession)
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            col = column(b, group)
            null = np.asarray(col.is_null())
            value = col.fill_null(0).to_numpy(zero_copy_only=False)
            new = np.ones(b.num_rows, bool)
            new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
            new[0] = (value[0], null[0]) != before
            at = np.arange(b.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            local = np.where(start >= 0, at - start, at + seen)
            before, seen = (value[-1], null[-1]), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(np.full(b.num_rows, part)), pa.array(local)],
                                             names=[*names, "_part", "_local"])

    schema = StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_local", LongType())])
    local = written(ranged.mapInArrow(count, schema), "places")
    # of each task the first group, and the last one with its rows: small tables, a row per task
    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(F.col(group)), F.struct(F.col(group).isNotNull(), F.col(group))).alias("first"),
        F.max_by(F.struct(F.col(group), "_local"), F.struct(F.col(group).isNotNull(), F.col(group), "_local")).alias("last"))
    ends = written(ends.select("_part", F.col(f"first.{group}").alias("first"), F.col(f"last.{group}").alias("last"),
                               (F.col("last._local") + 1).alias("n")), "ends")
    here = ends.select(F.col("_part").alias("op"), F.col("first").alias("og"))
    earlier = ends.select(F.col("_part").alias("p"), F.col("last").alias("l"), F.col("n").alias("more"))
    offset = here.join(earlier, F.col("og").eqNullSafe(F.col("l")) & (F.col("p") < F.col("op")))
    offset = offset.groupBy("op", "og").agg(F.sum("more").alias("_offset"))
    offset = written(offset, "offsets")
    joined = local.join(offset, (local["_part"] == offset["op"]) & local[group].eqNullSafe(offset["og"]), "left")
    return joined.select(*[local[c] for c in names], (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias(place))
