"""String expressions with JavaScript-compatible semantics, as plain Column expressions.

Spark's ``trim`` strips only spaces and Java's ``(?U)\\s`` differs from the
JavaScript whitespace set, so the set is spelled out.  ``$`` in Java also matches
before a final line break, so every anchored pattern ends with ``\\z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript whitespace set (String.prototype.trim and \s):
# U+0009-000D, U+0020, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F,
# U+205F, U+3000, U+FEFF.  U+0085 is deliberately absent.
JS_WS = (
    r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
JS_TRIM_PATTERN = rf"^{JS_WS}+|{JS_WS}+\z"
# the same set as plain characters, for btrim / translate (no regex engine per row)
_WS_RANGES = [(0x9, 0xD), (0x20, 0x20), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
              (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
JS_WS_CHARS = "".join(chr(c) for lo, hi in _WS_RANGES for c in range(lo, hi + 1))

# Error-report escaping.  A cell is quoted when it holds a double
# quote, comma, CR or LF; text starting with = + - @ TAB CR that is not a plain
# number gets a leading apostrophe (spreadsheet formula guard).
NEEDS_QUOTES = r'[",\r\n]'
FORMULA_PREFIX = r"^[=+\-@\t\r]"
PLAIN_NUMBER = r"^[+-]?\d+(\.\d+)?\z"


def js_trim(c: Column) -> Column:
    """``String.prototype.trim``: ``btrim`` with the whitespace set, a codegen string scan."""
    return F.btrim(c, F.lit(JS_WS_CHARS))


def collapse_ws(c: Column) -> Column:
    """Trim, then collapse every whitespace run to one space.

    Every whitespace character becomes a space (``translate``); only text that then holds
    two spaces in a row needs the regex.
    """
    spaced = F.translate(js_trim(c), JS_WS_CHARS, " " * len(JS_WS_CHARS))
    return F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, as JavaScript's ``.length`` counts (emoji = 2).

    ASCII text (bytes == characters) skips the transcoding.
    """
    n = F.length(c).cast("bigint")
    return F.when(F.octet_length(c) == n, n).otherwise((F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint"))


def is_blank(c: Column) -> Column:
    return F.length(js_trim(F.coalesce(c, F.lit("")))) == 0


def formula_guard(c: Column) -> Column:
    return F.when(c.rlike(FORMULA_PREFIX) & ~c.rlike(PLAIN_NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def csv_quote(c: Column) -> Column:
    return F.when(
        c.rlike(NEEDS_QUOTES), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(c)


def csv_escape(c: Column) -> Column:
    """Report cell text: formula guard first, then quoting."""
    return csv_quote(formula_guard(c))


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *cells)


def slug_latin(c: Column) -> Column:
    """Lowercase ASCII slug: strip accents with ``unaccent``-style folding, keep [a-z0-9]."""
    return F.regexp_replace(F.lower(_fold_accents(c)), "[^a-z0-9]", "")


def _fold_accents(c: Column) -> Column:
    # NFD + drop combining marks is done by the pandas helper in functions.slug;
    # this cheaper path covers Latin-1 / Latin Extended-A letters with a translate table.
    return F.translate(c, _ACCENTED, _PLAIN)


# Latin letters with diacritics and their base letters (NFD base).
_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ"
_PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy"
