"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item gives windows of ``WINDOW`` consecutive words (an item of fewer words is
one window).  A window is a set of ``SHINGLE``-word shingles; a text contains the window only
if it contains all of them, so in any order of the shingles a prefix of one shingle is
necessary.  The order is rarity: how often each shingle occurs in all documents.

1. One scan of the documents finds where any item shingle occurs.  Words stay inside one
   generated stage; only places that match leave it, each with the few words around it.
2. Those places give each shingle's frequency over all documents; each window keeps its rarest
   shingle as the prefix that is joined.
3. A place and a window that share the prefix shingle must agree on position (the window starts
   at or after the text's start) and length (it ends at or before the text's end).
4. What is left is verified word by word over a span as long as the window.

Item shingles are broadcast in blocks of at most ``BLOCK`` (8 bytes each), whatever their
number; a larger benchmark means more scans, not larger broadcasts.

Edge cases: a null text has no words; a null item is no window, an item with a null id makes
hits but is not listed; rows that share doc_id and text are worked out once and returned as
often as they came; equal windows of several items count for each; an empty table on either
side gives no hits; only doc_id, text and item_id, text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import row_key, written

WINDOW = 10
SHINGLE = 3
BLOCK = 1 << 20
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased words: runs of digits, letters and anything beyond ASCII."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)  # lower() is the same there, and cheaper
    folded = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(folded, NO_WORD), "")


def windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, words of the window, its shingle size ``q`` and, per shingle, hash ``h`` and offset ``j``."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    w = w.select("item_id", "w", size.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    w = w.select("item_id", F.slice("w", F.col("at"), F.col("n")).alias("win"), F.least("n", F.lit(shingle)).alias("q")).distinct()
    j = F.explode(F.sequence(F.lit(0), F.size("win") - F.col("q"))).alias("j")
    w = w.select("item_id", "win", "q", j)
    return w.withColumn("h", F.expr(_hash("win", "j", shingle)))


def _hash(array: str, at: str, q: int) -> str:
    """Hash of up to q words from position ``at``; words beyond the end are left out of it."""
    return "xxhash64(" + ", ".join(f"get({array}, {at} + {k})" for k in range(q)) + ")"


def places(docs: DataFrame, grams: DataFrame, q: int, window: int) -> DataFrame:
    """Where shingles of ``q`` words from ``grams`` (h) occur, with the words around them; besides, a
    row without ``h`` for each document."""
    d = docs.select("doc_id", row_key().alias("key"), words(F.col("text")).alias("w"))
    d = d.select("doc_id", "key", F.size("w").alias("n_words"), "w", F.posexplode_outer("w").alias("pos", "word"))
    d = d.withColumn("h", F.when(F.col("pos") + q <= F.col("n_words"), F.expr(_hash("w", "pos", q))))
    d = d.join(F.broadcast(grams.withColumn("found", F.lit(True))), "h", "left")
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    d = d.where(F.col("found") | first)
    start = F.greatest(F.lit(0), F.col("pos") - (window - q))
    return d.select(
        "doc_id", "key", "n_words", first.alias("first"), "pos", F.when(F.col("found"), F.col("h")).alias("h"),
        start.alias("around_at"), F.when(F.col("found"), F.slice("w", start + 1, 2 * window - q)).alias("around"),
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """Per document: doc_id, key (of its text), copies, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = written(windows(benchmark, window, shingle), "windows")
    blocks = wins.groupBy("q").agg(F.count_distinct("h").alias("n")).collect()  # a row per shingle size, at most 3
    todo = [(r.q, b, -(-r.n // block)) for r in blocks for b in range(-(-r.n // block))] or [(shingle, 0, 1)]
    parts = []
    for k, (q, b, of) in enumerate(todo):
        grams = wins.where((F.col("q") == q) & (F.pmod("h", F.lit(of)) == b)).select("h").distinct()
        p = places(docs, grams, q, window).withColumn("q", F.lit(q))
        parts.append(p if k == 0 else p.where(F.col("h").isNotNull()).withColumn("first", F.lit(False)))
    found = written(reduce(DataFrame.unionByName, parts), "places")

    # rarity over all documents; of a window's shingles the rarest is its prefix
    often = found.where(F.col("h").isNotNull()).groupBy("q", "h").agg(F.count("*").alias("often"))
    ranked = wins.join(often, ["q", "h"], "left").groupBy("item_id", "win", "q").agg(
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "h", "j")).alias("p")
    )
    prefix = written(ranked.where("p.often > 0").select("item_id", "win", "q", "p.h", "p.j"), "prefixes")

    start = F.col("pos") - F.col("j")
    met = found.where(F.col("h").isNotNull()).join(prefix, ["q", "h"])
    met = met.where((start >= 0) & (start + F.size("win") <= F.col("n_words")))
    met = met.where(F.slice("around", start - F.col("around_at") + 1, F.size("win")) == F.col("win"))
    hits = met.select(
        "doc_id", "key", F.lit(None).cast("int").alias("n_words"), F.lit(0).alias("one"),
        F.struct(start.alias("a"), (start + F.size("win")).alias("b")).alias("hit"), "item_id",
    )
    item_type = benchmark.schema["item_id"].dataType
    rows = found.where("first").select(
        "doc_id", "key", "n_words", F.lit(1).alias("one"),
        F.lit(None).cast(hits.schema["hit"].dataType).alias("hit"), F.lit(None).cast(item_type).alias("item_id"),
    )
    per_doc = rows.unionByName(hits).groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"), F.sum("one").alias("copies"),
        F.array_sort(F.collect_set("hit")).alias("hits"), F.collect_set("item_id").alias("items"),
    )
    union = F.expr(  # words covered by spans in order of their starts
        "aggregate(hits, named_struct('n', 0L, 'e', 0), (s, x) -> named_struct("
        "'n', s.n + greatest(0, x.b - greatest(x.a, s.e)), 'e', greatest(s.e, x.b))).n"
    )
    listed = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return per_doc.select(
        "doc_id", "key", "copies", F.col("n_words").cast("long").alias("n_words"), union.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each row of ``docs``."""
    found = contamination(docs, benchmark, **options)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.drop("key", "copies", "copy")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns kept."""
    bad = written(contamination(docs, benchmark, **options).where("contaminated").select("doc_id", "key"), "contaminated")
    bad = bad.select(F.col("doc_id").alias("_bad_doc"), F.col("key").alias("_bad_key"))
    same = docs["doc_id"].eqNullSafe(bad["_bad_doc"]) & (row_key(docs["text"]) == bad["_bad_key"])
    return docs.join(bad, same, "left_anti")


_SQL_WORDS = (
    f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[p:p + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, p, n, item_id FROM spots JOIN wins USING (n, s)),
covered AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS x FROM hits) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
