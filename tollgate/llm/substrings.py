"""Exact removal of repeated byte strings, by interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same
document or in another.  The whole corpus is not one suffix array: a string of 200 bytes has a
smallest 50-byte gram by hash, its *anchor*, wherever it stands, so equal strings meet at equal
anchors.

1. One scan finds the anchors.  Each owns a run of string starts; its *context* is the bytes of
   their strings.  Written are the anchor's hash, the context's hash and the place (narrow).
2. Anchors seen once are gone.  Where all contexts of an anchor agree, all their strings repeat.
   Contexts that occur twice repeat as a whole.  All this is counted, partially before a shuffle.
3. What remains are contexts that occur once beside others of the same anchor: the rims of
   repeated passages.  One copy of each different context is fetched, and per group of anchors
   a Burrows-Wheeler transform is expanded breadth first: intervals of ever longer strings are
   extended backwards, which yields common prefixes in increasing order, and the expansion
   stops at ``LENGTH``.  Suffixes whose common prefix it has not bounded by then repeat.
4. An anchor with more than ``CROWD`` different contexts isn't taken by one task: the strings of
   its contexts are counted by their hashes instead.
5. The repeated runs of each document are joined back to its text.

Nothing is capped: every string of every document is decided, also across the pieces of
``CHUNK`` bytes in which a very long text is scanned.

Edge cases: null and empty texts have no bytes and lose none; texts shorter than ``LENGTH``
lose none; rows that share doc_id and text repeat each other and are each returned; a null
doc_id is a document like any other; an empty table gives an empty one; only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import bound_batches, byte_texts, column, free, fresh, map_batches, remove, row_key, scratch, written

LENGTH = 200            # bytes of a string
GRAM = 50               # bytes of an anchor
CROWD = 4096            # different contexts of an anchor that one task expands
CHUNK = 1 << 20         # bytes scanned together
EXPAND = 1 << 20        # bytes of contexts expanded together

# ---- anchors -----------------------------------------------------------------

BASE = 0x9E3779B97F4A7C15
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = 1
    return np.cumprod(p, dtype=U)


class Rolling:
    """Hashes of any run of bytes of a chunk, from prefix sums modulo 2^64."""

    up = down = np.zeros(0, U)

    def __init__(self, data: np.ndarray):
        if len(Rolling.up) <= len(data):
            n = max(CHUNK, len(data)) + 1
            Rolling.up, Rolling.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * Rolling.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * (Rolling.down[start])
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        return h ^ (h >> U(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """(text, first start, last start, hash, context hash) of each anchor of a chunk of texts that end at ``ends``."""
    n, w = len(data), length - gram + 1
    m, g = n - length + 1, n - gram + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    roll = Rolling(data)
    h = roll.of(slice(0, g), slice(gram, n + 1))
    bits = U((1 << 21) - 1)
    key = np.full(-(-g // w) * w, U(2**64 - 1))
    key[:g] = (h & ~bits) | np.arange(g, dtype=U)  # of equal hashes the first
    key = key.reshape(-1, w)
    ahead = np.minimum.accumulate(key, axis=1).ravel()
    behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:m], ahead[w - 1 : w - 1 + m]) & bits).astype(np.int64)
    text = np.searchsorted(ends, np.arange(m), "right")
    inside = np.arange(m) + length <= ends[text]
    new = np.ones(m, bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new | ~inside), m)
    last = stops[np.searchsorted(stops, first, "right")] - 1
    shape = (at[first] - first).astype(U) * U(0x2545F4914F6CDD1D) + (last - first).astype(U)
    context = roll.of(first, last + length) * U(0xFF51AFD7ED558CCD) + shape
    return text[first], first, last, h[at[first]], context ^ (context >> U(31))


def chunks(batch: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, row of each text, byte of its row at which it begins); longer texts in overlapping pieces."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        ends = np.cumsum([len(p) for *_, p in parts])
        return np.frombuffer(b"".join(p for *_, p in parts), np.uint8), ends, np.array([r for r, _, _ in parts]), np.array([a for _, a, _ in parts])

    for row, t in enumerate(batch):
        for a in range(0, max(1, len(t) - length + 1), CHUNK - length + 1):
            piece = t[a : a + CHUNK]
            if len(piece) < length:
                continue
            if size + len(piece) > CHUNK:
                yield close()
                parts, size = [], 0
            parts.append((row, a, piece))
            size += len(piece)
    if parts:
        yield close()


def find_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """h, ctx, doc_id, key, s1, s2 (starts that the anchor owns), e1 (last start of one context), n.

    A context that occurs again in the same text has n = 2, and runs of it (a text that repeats
    with a short period) are one row.
    """

    def run(batch: pa.RecordBatch):
        ids, keys = column(batch, "doc_id").cast(pa.int64()), column(batch, "key")
        for data, ends, row, begin in chunks(byte_texts(batch), length):
            text, s1, s2, h, ctx = anchors(data, ends, length, gram)
            if not len(h):
                continue
            order = np.lexsort((ctx, h, text))
            same = (text[order][1:] == text[order][:-1]) & (h[order][1:] == h[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            goes_on = np.zeros(len(h), bool)
            goes_on[1:] = twice[1:] & (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1]) & (s1[1:] == s2[:-1] + 1)
            lead = np.flatnonzero(~goes_on)
            tail = np.append(lead[1:], len(h)) - 1
            t = text[lead]
            shift = begin[t] - (ends[t] - np.diff(ends, prepend=0)[t])
            at = pa.array(row[t])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[lead].view(np.int64)), pa.array(ctx[lead].view(np.int64)), ids.take(at), keys.take(at),
                 *(pa.array((x + shift).astype(np.int32)) for x in (s1[lead], s2[tail], s2[lead])),
                 pa.array(np.where(twice[lead], 2, 1).astype(np.int32))],
                names=["h", "ctx", "doc_id", "key", "s1", "s2", "e1", "n"],
            )

    return map_batches(
        docs.select("doc_id", row_key().alias("key"), "text"), run,
        "h long, ctx long, doc_id long, key long, s1 int, s2 int, e1 int, n int",
    )


# ---- the transform -----------------------------------------------------------


def suffix_order(s: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of a symbol array (below 512) ordered by at least their first ``length`` symbols."""
    n, k = len(s), 7
    padded = np.concatenate([s.astype(np.int64), np.zeros(k, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(k):
        key = (key << 9) | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[order][1:] != key[order][:-1]
        if k >= length or step.sum() == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        k *= 2


def bounded_prefixes(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``; -1 where it is ``length`` or more.

    Breadth-first backward extension: an interval of suffixes that begin with a string becomes
    the intervals of that string behind each symbol that precedes it.  The end of a new interval
    separates suffixes that agree just so far; an end that is known already need not be followed.
    """
    n = len(s)
    before = s[order - 1]  # the transform; the text is taken as a circle
    by_symbol = np.argsort(before, kind="stable")
    to = np.empty(n, np.int64)
    to[by_symbol] = np.arange(n)  # where the suffix that is one symbol longer stands
    same = before[by_symbol][1:] == before[by_symbol][:-1]
    after, prior = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    prior[by_symbol[1:][same]] = by_symbol[:-1][same]
    found = np.full(n + 1, -1, np.int16)
    found[0] = found[n] = 0
    lo, hi = np.array([0]), np.array([n])
    for known in range(length):
        if not len(lo):
            break
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(owner)) + np.repeat(lo - (np.cumsum(size) - size), size)
        is_first, is_last = prior[at] < lo[owner], after[at] >= hi[owner]
        firsts = np.sort((owner[is_first] << 32) | to[at[is_first]]) & 0xFFFFFFFF
        lasts = (np.sort((owner[is_last] << 32) | to[at[is_last]]) & 0xFFFFFFFF) + 1
        fresh = found[lasts] < 0
        lo, hi = firsts[fresh], lasts[fresh]
        found[hi] = known
    return found[:n]


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """Per body: whether the string of ``length`` bytes at each start also starts elsewhere in any of them."""
    sizes = np.array([len(b) + 1 for b in bodies])
    s = np.zeros(int(sizes.sum()), np.uint16)
    begin = np.cumsum(sizes) - sizes
    full = np.zeros(len(s), bool)
    for a, b in zip(begin.tolist(), bodies):
        s[a : a + len(b)] = np.frombuffer(b, np.uint8)
        s[a : a + len(b)] += 1
        full[a : a + max(0, len(b) - length + 1)] = True
    order = suffix_order(s, length)
    group = np.cumsum(bounded_prefixes(s, order, length) >= 0)
    own = full[order]
    many = np.bincount(group, weights=own)[group] >= 2
    out = np.zeros(len(s), bool)
    out[order[own & many]] = True
    return [out[a : a + max(0, len(b) - length + 1)] for a, b in zip(begin.tolist(), bodies)]


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of set flags, both ends included."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def expand(contexts: DataFrame, length: int) -> DataFrame:
    """h, ctx and the repeated runs of starts of contexts (h, ctx, body) within their anchor's group."""
    bound_batches(contexts.sparkSession)

    def verdict(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        rows = [(h, c, r) for (h, c, _), f in zip(held, repeated_starts([b for *_, b in held], length)) if (r := runs(f))]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], SPANS)], names=["h", "ctx", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for h, c, b in zip(*(column(batch, x).to_pylist() for x in ("h", "ctx", "body"))):
                if held and held[-1][:2] == (h, c):
                    continue  # the same context, from a row that repeats
                if size >= EXPAND and held[-1][0] != h:  # groups stay whole
                    yield verdict(held)
                    held, size = [], 0
                held.append((h, c, b))
                size += len(b)
        if held:
            yield verdict(held)

    parts = contexts.repartition("h").sortWithinPartitions("h", "ctx")
    return parts.mapInArrow(run, "h long, ctx long, spans array<struct<a:int,b:int>>")


def count_strings(contexts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many contexts: strings counted by hash, in no task all of a group."""

    def run(batch: pa.RecordBatch):
        for h, c, b in zip(*(column(batch, x).to_pylist() for x in ("h", "ctx", "body"))):
            start = np.arange(len(b) - length + 1)
            of = Rolling(np.frombuffer(b, np.uint8)).of(start, start + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), h)), pa.array(np.full(len(of), c)), pa.array(start.astype(np.int32)), pa.array(of.view(np.int64))],
                names=["h", "ctx", "start", "string"],
            )

    strings = map_batches(contexts, run, "h long, ctx long, start int, string long").distinct()
    often = strings.groupBy("h", "string").agg(F.count("*").alias("n")).where("n > 1").select("h", "string")
    found = strings.join(often, ["h", "string"]).groupBy("h", "ctx")
    return found.agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("a"), F.col("start").alias("b")))).alias("spans"))


# ---- the job -----------------------------------------------------------------


def fetch(docs: DataFrame, pool: DataFrame, length: int) -> DataFrame:
    """h, ctx, crowded, body: the bytes of one context each, from the text that has it."""
    asked = pool.groupBy(F.col("rep.doc_id").alias("_doc"), F.col("rep.key").alias("_key")).agg(
        F.collect_list(F.struct("h", "ctx", "crowded", "rep.s1", "rep.e1")).alias("asked")
    )
    d = docs.select("doc_id", row_key().alias("key"), "text")
    d = d.join(asked, d["doc_id"].eqNullSafe(asked["_doc"]) & (d["key"] == asked["_key"])).select("text", "asked")

    def run(batch: pa.RecordBatch):
        out = [
            (a["h"], a["ctx"], a["crowded"], t[a["s1"] : a["e1"] + length])
            for t, asked_here in zip(byte_texts(batch), column(batch, "asked").to_pylist())
            for a in asked_here
        ]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["h", "ctx", "crowded", "body"])

    return map_batches(d, run, "h long, ctx long, crowded boolean, body binary")


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, key and the runs of starts whose strings repeat (a to b), for texts that have any."""
    spark = docs.sparkSession
    path = scratch(spark, "anchors")
    find_anchors(docs, length, gram).write.parquet(path)
    all_anchors = spark.read.parquet(path)
    per_anchor = all_anchors.groupBy("h").agg(F.sum("n").alias("n"), F.min("ctx").alias("least"), F.max("ctx").alias("most"))
    again = written(per_anchor.where("n > 1").select("h", (F.col("least") != F.col("most")).alias("mixed")), "again")
    free(spark)
    kept = written(all_anchors.join(again, "h"), "kept")
    free(spark)
    remove(spark, path)

    mixed = kept.where("mixed")
    contexts = written(
        mixed.groupBy("h", "ctx").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "key", "s1", "e1")).alias("rep")), "contexts"
    )
    groups = contexts.groupBy("h").agg(F.min("n").alias("least"), F.count("*").alias("of"))
    groups = groups.where("least = 1").select("h", (F.col("of") > crowd).alias("crowded"))
    bodies = written(fetch(docs, contexts.join(groups, "h"), length), "bodies")
    free(spark)
    verdict = expand(bodies.where("not crowded").select("h", "ctx", "body"), length)
    if not bodies.where("crowded").isEmpty():
        verdict = verdict.unionByName(count_strings(bodies.where("crowded").select("h", "ctx", "body"), length))
    verdict = written(verdict, "verdict")
    free(spark)

    whole = F.array(F.struct(F.lit(0).alias("a"), (F.col("s2") - F.col("s1")).alias("b")))
    decided = written(
        contexts.select("h", "ctx", (F.col("n") > 1).alias("all")).join(verdict, ["h", "ctx"], "left").where("all or spans is not null"), "decided"
    )
    spans = mixed.join(decided, ["h", "ctx"]).select("doc_id", "key", "s1", F.when(F.col("all"), whole).otherwise(F.col("spans")).alias("spans"))
    spans = spans.unionByName(kept.where("not mixed").select("doc_id", "key", "s1", whole.alias("spans")))
    spans = spans.select("doc_id", "key", "s1", F.explode("spans").alias("x"))
    spans = spans.select("doc_id", "key", F.struct((F.col("s1") + F.col("x.a")).alias("a"), (F.col("s1") + F.col("x.b")).alias("b")).alias("run"))
    return written(spans.groupBy("doc_id", "key").agg(F.collect_set("run").alias("runs")), "runs")


def cut(text: bytes, found: list[dict] | None, length: int) -> tuple[bytes, int]:
    """(the bytes that stay, number of maximal removed runs)."""
    out, at, spans = [], 0, 0
    end = -1
    for a, b in sorted((r["a"], r["b"]) for r in found or []):
        if a > end:
            out.append(text[at:a])
            spans += 1
        end = max(end, b + length)
        at = end
    return b"".join(out) + text[at:], spans


def _with_runs(docs: DataFrame, length: int, options: dict) -> tuple[DataFrame, str]:
    """``docs`` and the name of the added column with their runs."""
    name = fresh("runs", docs)
    found = repeated_runs(docs, length, **options).select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("runs").alias(name))
    free(docs.sparkSession)
    same = docs["doc_id"].eqNullSafe(found["_doc"]) & (row_key(docs["text"]) == found["_key"])
    return docs.join(found, same, "left").select(*(docs[c] for c in docs.columns), found[name]), name


def report(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    both, name = _with_runs(docs.select("doc_id", "text"), length, options)

    def run(batch: pa.RecordBatch):
        rows = []
        for t, found in zip(byte_texts(batch), column(batch, name).to_pylist()):
            left, spans = cut(t, found, length)
            rows.append((len(t), len(t) - len(left), spans, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return map_batches(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` without repeated strings; a character cut in two becomes a replacement character."""
    both, name = _with_runs(docs, length, options)

    def run(batch: pa.RecordBatch):
        at = batch.schema.get_field_index("text")
        old, found = byte_texts(batch), column(batch, name).to_pylist()
        was = column(batch, "text").to_pylist()
        new = [cut(t, r, length)[0].decode(errors="replace") if r else w for t, r, w in zip(old, found, was)]
        yield batch.set_column(at, batch.schema.field("text"), pa.array(new, batch.schema.field("text").type)).drop_columns([name])

    return map_batches(both, run, docs.schema)
