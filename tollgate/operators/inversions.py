"""Adjacent pairs out of order between insert order and a storage key.

``lag`` over the whole input would need one task.  Instead rows get a dense
ordinal (the bucketed running count of ``operators.running``), are grouped in
buckets of 2^12 consecutive ordinals, ``lag`` runs per bucket, and each
bucket's first key is compared with the previous bucket's last key through an
equi-join on ``bucket - 1`` (dense ordinals leave no empty bucket).  No window
runs without ``partitionBy``.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.running import running_sums

BUCKET_BITS = 12


def order_inversions(df: DataFrame, order_col: str, keys: Mapping[str, str]) -> DataFrame:
    """One row; for each ``out_name -> key_col``: #{i : key[i] < key[i-1]} along ``order_col``."""
    names = list(keys)
    base = df.select(F.col(order_col).alias("_o"), *[F.col(c).alias(f"_k_{n}") for n, c in keys.items()]) \
        .withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_sums(base, "_o", ["_one"]).withColumn("_b", F.shiftright(F.col("_one_through") - 1, BUCKET_BITS))
    w = Window.partitionBy("_b").orderBy("_o")
    within = ranked.select(*[
        F.when(F.lag(f"_k_{n}").over(w).isNotNull() & (F.col(f"_k_{n}") < F.lag(f"_k_{n}").over(w)), 1)
        .otherwise(0).alias(f"_inv_{n}")
        for n in names
    ])
    ends = ranked.groupBy("_b").agg(
        *[F.min_by(f"_k_{n}", "_o").alias(f"_first_{n}") for n in names],
        *[F.max_by(f"_k_{n}", "_o").alias(f"_last_{n}") for n in names],
    )
    prev = ends.select((F.col("_b") + 1).alias("_b"), *[F.col(f"_last_{n}").alias(f"_plast_{n}") for n in names])
    boundary = ends.join(prev, "_b", "inner").select(*[
        F.when(F.col(f"_first_{n}") < F.col(f"_plast_{n}"), 1).otherwise(0).alias(f"_inv_{n}")
        for n in names
    ])
    return within.unionByName(boundary).agg(*[F.sum(f"_inv_{n}").cast("bigint").alias(n) for n in names])
