"""C8 slug: NFD, drop combining marks, lowercase, keep [a-z0-9].

Unicode decomposition has no built-in Spark expression.  Text of Latin letters
(up to U+024F) needs none: a ``translate`` table, derived from Unicode's own
decompositions, takes letters to their base within the JVM.  Only text with
other characters goes to an Arrow-batched pandas UDF; other rows reach it as
nulls.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_SLUG = re.compile(r"[^a-z0-9]")


def _slug_one(value: str | None) -> str | None:
    if value is None:
        return None
    decomposed = unicodedata.normalize("NFD", value)
    stripped = "".join(ch for ch in decomposed if not unicodedata.category(ch).startswith("M"))
    return _NOT_SLUG.sub("", stripped.lower())


def _slug_series(values: pd.Series) -> pd.Series:
    return values.map(_slug_one)


_UDF = None


def _latin() -> tuple[str, str, str]:
    """(characters that the JVM branch knows, accented ones of them, their bases)."""
    known, accented, bases = "", "", ""
    for ch in map(chr, [*range(1, 0x250), *range(0x300, 0x370)]):
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.category(x).startswith("M"))
        if len(base) > 1:
            continue
        known += ch
        if base and base != ch:
            accented, bases = accented + ch, bases + base
    return known, accented, bases


_KNOWN, _ACCENTED, _BASES = _latin()


def slug(c: Column) -> Column:
    latin = F.translate(c, _KNOWN, "") == ""
    within = F.regexp_replace(F.lower(F.translate(c, _ACCENTED, _BASES)), "[^a-z0-9]", "")
    return F.when(latin, within).otherwise(_beyond_latin(F.when(~latin, c)))


def _beyond_latin(c: Column) -> Column:
    global _UDF
    if _UDF is None:  # built on first use: declaring a UDF needs an active session
        from pyspark.sql import types as T

        _UDF = F.pandas_udf(_slug_series, T.StringType())
    return _UDF(c)
