"""Time-ordered ids (RFC 9562 version 7) as a column expression, and their timestamp.

Layout (128 bits): 48-bit Unix milliseconds of the run | version 7 | a 40-bit
counter (the row's position in input order) split around the variant bits |
34 bits of ``xxhash64`` over the row key.  Ids sort in generation order within
a run and across runs, like the reference's per-row v7 ids, and need no
driver-side state: every task computes its rows' ids independently and a task
retry reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VARIANT = -(1 << 63)  # top bits '10' once the counter (bits 34..61) is OR-ed in
_MASK12, _MASK28, _MASK34 = (1 << 12) - 1, (1 << 28) - 1, (1 << 34) - 1


def _hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def uuid7(run_ms: Column, counter: Column, *key: Column) -> Column:
    """``run_ms``: epoch milliseconds (bigint); ``counter``: non-negative < 2^40."""
    hi = (
        F.shiftleft(run_ms.cast("bigint"), 16)
        .bitwiseOR(F.lit(0x7000))
        .bitwiseOR(F.shiftright(counter, 28).bitwiseAND(F.lit(_MASK12)))
    )
    lo = (
        F.lit(_VARIANT)
        .bitwiseOR(F.shiftleft(counter.bitwiseAND(F.lit(_MASK28)), 34))
        .bitwiseOR(F.xxhash64(run_ms, counter, *key).bitwiseAND(F.lit(_MASK34)))
    )
    h, lo_hex = _hex16(hi), _hex16(lo)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
        F.substring(lo_hex, 1, 4), F.substring(lo_hex, 5, 12),
    )


COUNTER_BITS = 40
MAX_COUNTER = (1 << COUNTER_BITS) - 1
COUNTER_RANGE = "Row position below zero"


def row_counter(ordinal: Column) -> Column:
    """The id's counter: the low 40 bits of a row's position in the whole input."""
    n = ordinal.cast("bigint")
    return F.when(n >= 0, n.bitwiseAND(F.lit(MAX_COUNTER))).otherwise(F.raise_error(F.lit(COUNTER_RANGE)).cast("bigint"))


def row_millis(run_ms: Column, ordinal: Column) -> Column:
    """The id's milliseconds: one more for every 2^40 rows, so that ids never run out within a run."""
    return run_ms + F.shiftright(ordinal.cast("bigint"), COUNTER_BITS)


def millis_needed(rows: int) -> int:
    """Milliseconds that a run of so many rows takes its ids from."""
    return (max(rows, 0) >> COUNTER_BITS) + 1


def uuid7_millis(uid: Column) -> Column:
    """The first 48 bits: Unix epoch milliseconds."""
    return F.conv(F.substring(F.replace(uid, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("bigint")


def uuid7_timestamp(uid: Column) -> Column:
    """The embedded time as a UTC wall-clock ``timestamp_ntz`` (independent of the session zone)."""
    secs = (uuid7_millis(uid) / F.lit(1000)).cast("decimal(18,3)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=secs)


def uuid7_version(uid: Column) -> Column:
    return F.substring(uid, 15, 1)
