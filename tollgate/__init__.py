"""tollgate: a PySpark engine that admits untrusted delimited rows into a table.

Every stage is a DataFrame plan: line-numbered CSV scan, per-field rules as
``CASE`` chains, one-row-per-key enforcement against the target and inside the
input, an ordered error report, counters, and a job ledger derived from events.
"""

from tollgate.session import get_spark, scratch_path  # noqa: F401

__all__ = ["get_spark", "scratch_path"]
