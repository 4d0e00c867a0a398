"""Whitespace trim and collapse against a plain-Python model of JavaScript's semantics.

The Spark expressions use ``btrim`` / ``translate``; the model uses the same
whitespace set spelled as code points.  Random strings mix every whitespace
character with look-alikes that are not whitespace in JavaScript (U+0085,
U+200B, U+180E), letters, a combining mark and an astral emoji.
"""

import random

from pyspark.sql import functions as F

from tollgate.functions.text import collapse_ws, js_trim

# JavaScript's whitespace set (String.prototype.trim and \s).
JS_WHITESPACE = (
    {chr(c) for c in range(0x9, 0xE)}
    | {chr(c) for c in range(0x2000, 0x200B)}
    | {"\u0020", "\u00a0", "\u1680", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff"}
)
NOT_WHITESPACE = ["\u0085", "\u200b", "\u180e", "a", "Z", "\u00e9", "\u0301", "\U0001f600", "-", "'", '"']


def model_trim(s: str) -> str:
    i, j = 0, len(s)
    while i < j and s[i] in JS_WHITESPACE:
        i += 1
    while j > i and s[j - 1] in JS_WHITESPACE:
        j -= 1
    return s[i:j]


def model_collapse(s: str) -> str:
    out, in_ws = [], False
    for ch in model_trim(s):
        if ch in JS_WHITESPACE:
            if not in_ws:
                out.append(" ")
            in_ws = True
        else:
            out.append(ch)
            in_ws = False
    return "".join(out)


def test_trim_and_collapse_match_javascript_model(spark):
    rnd = random.Random(7)
    alphabet = sorted(JS_WHITESPACE) + NOT_WHITESPACE
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 10))) for _ in range(3000)]
    texts += ["", " ", "\ufeffname\ufeff", "\u0085x\u0085", "a\u3000\u3000b", "  a  b  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r["i"]: (r["t"], r["c"]) for r in df.select("i", js_trim(F.col("s")).alias("t"),
                                                        collapse_ws(F.col("s")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (model_trim(t), model_collapse(t)), repr(t)


def test_slug_within_and_beyond_latin(spark):
    """The JVM branch and the UDF agree with a plain-Python decomposition."""
    import unicodedata

    from tollgate.functions.slug import slug

    rng = random.Random(5)
    marks = [chr(c) for c in [*range(0x20, 0x250), 0x301, 0x327]] + ["\u212a", "\u1e9e", "\u1ebf", "日", "\U0001f600", "\ufb01"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 12)))) for i in range(800)] + [(900, None), (901, ""), (902, "İSTANBUL ǅ ß K")]

    def model(s):
        if s is None:
            return None
        d = "".join(ch for ch in unicodedata.normalize("NFD", s) if not unicodedata.category(ch).startswith("M"))
        return "".join(ch for ch in d.lower() if ch in "abcdefghijklmnopqrstuvwxyz0123456789")

    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", slug(F.col("t")).alias("s")).collect()}
    assert got == {i: model(t) for i, t in rows}
