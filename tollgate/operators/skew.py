"""Joining rows back to per-key facts when one key may hold a third of the rows.

The per-key side comes from an aggregation (one row per key, with the row
count ``n`` of that key), so it is partitioned by the key already and AQE's
skew-join split -- which needs shuffle stages directly under the join -- does
not apply.  Heavy keys are therefore handled explicitly:

* ``hot_keys``: the at most ``MAX_HOT_KEYS`` keys with more than ``HOT_ROWS``
  rows -- a top-k over the per-key table, so what reaches the driver and what
  is broadcast is bounded by ``MAX_HOT_KEYS`` whatever the input size;
* ``hot_split_join``: rows of hot keys join the broadcast facts of those keys
  map-side (they never shuffle, so a hot key is spread over every task that
  reads it); all other rows take an ordinary shuffle join, where no key has
  more than ``HOT_ROWS`` rows or the key is lighter than every broadcast one.
  Without hot keys it is a plain join.

Whole results: every row is joined exactly once, nothing is sampled or capped.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1 << 20          # a key above ~1M rows is handled map-side
MAX_HOT_KEYS = 10_000       # bound on hot keys collected and broadcast


def hot_keys(per_key: DataFrame, key: str, count_col: str = "_n") -> list:
    """Keys with more than ``HOT_ROWS`` rows, heaviest first, at most ``MAX_HOT_KEYS``."""
    top = (
        per_key.where(F.col(count_col) > HOT_ROWS)
        .orderBy(F.col(count_col).desc(), F.col(key))
        .limit(MAX_HOT_KEYS)
        .select(key)
        .collect()
    )
    return [r[0] for r in top]


def hot_split_join(rows: DataFrame, per_key: DataFrame, key: str, hot: Sequence) -> DataFrame:
    """Inner join ``rows`` with ``per_key`` (one row per ``key``), hot keys map-side."""
    if not hot:
        return rows.join(per_key, key, "inner")
    is_hot = F.col(key).isin(list(hot))
    hot_part = rows.where(is_hot).join(F.broadcast(per_key.where(is_hot)), key, "inner")
    cold_part = rows.where(~is_hot).join(per_key.where(~is_hot), key, "inner")
    return hot_part.unionByName(cold_part)
