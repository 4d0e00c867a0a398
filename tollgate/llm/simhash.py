"""SimHash near-duplicates by anchor-point covering.

Two fingerprints at most ``k`` bits apart have a word ``m`` half way between them, at most
``ceil(k / 2)`` bits from either.  The anchors are a covering code: every word has an anchor
within the covering radius, so ``m`` has one, and that anchor lies within radius plus
``ceil(k / 2)`` of both fingerprints.  Each fingerprint is therefore replicated to every
anchor within the radius plus its half of the threshold, and fingerprints are compared only
with those at the same anchor; no link is lost.

The code is the product of two perfect binary Golay codes (23 bits, radius 3) over the first
46 bits: 2^24 anchors with radius 6.  The radius is accounted per factor, so that a
fingerprint goes to about 9.6 anchors for ``k = 2`` (see ``near_anchors``).

Equal fingerprints are one before they are replicated, so groups of copies of any size cost
nothing here.  An anchor that more than ``CROWD`` different fingerprints share (near copies
without end) isn't compared pair by pair: its fingerprints go to all words within ``k / 2``
bits, the finest anchors there are.  Two fingerprints share such a word exactly if they link,
and a word is never shared by more than 65 for ``k = 2``, so links stay in proportion.

Edge cases: null and empty texts have fingerprint zero and link like any other; rows with a
null doc_id take part but give no component id; a component without any doc_id has null;
repeated rows are rows of one component; an empty table gives an empty one; only doc_id and
text are read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tollgate.llm.common import byte_texts, column, fresh, map_batches, row_key, written
from tollgate.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 2
CROWD = 512             # different fingerprints of an anchor that are compared pair by pair
STEP = 1 << 16          # shingles whose bits are counted together

# ---- fingerprints ------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if n <= shingle:
        spans = [(0, len(line))]
    else:
        spans = list(zip([0, *ends[: n - shingle]], (e - 1 for e in ends[shingle - 1 :])))
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(spans), STEP):
        h = np.array([digest(line[a:b], SEED) for a, b in spans[at : at + STEP]], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns but the text, and fp (the fingerprint's bits as a signed long)."""
    kept = docs.drop("text").schema
    names = kept.names

    def run(batch: pa.RecordBatch):
        fp = np.array([fingerprint(t, shingle) for t in byte_texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), pa.array(fp)], names=[*names, "fp"])

    return map_batches(docs, run, StructType([*kept.fields, StructField("fp", LongType())]))


# ---- the covering code -------------------------------------------------------

GOLAY = 0b110001110101  # generator polynomial of the (23, 12) code
LENGTH, RADIUS = 23, 3


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word by the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, 10, -1):
        r ^= np.where((r >> bit) & 1, GOLAY << (bit - 11), 0)
    return r


@lru_cache(maxsize=4)
def patterns(extra: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Differences between a word and the code words near it, by the word's syndrome.

    For a cost c from 0 to ``extra``: those of weight up to the radius for c = 0, of weight
    radius + c beyond, as (start, count) by syndrome into a list of differences.
    """
    out = []
    for c in range(extra + 1):
        weights = range(RADIUS + 1) if c == 0 else [RADIUS + c]
        e = np.array([sum(1 << b for b in bits) for w in weights for bits in combinations(range(LENGTH), w)], np.int64)
        s = syndromes(e)
        order = np.argsort(s, kind="stable")
        count = np.bincount(s, minlength=1 << 11)
        out.append((np.concatenate([[0], np.cumsum(count)[:-1]]), count, e[order]))
    return out


def near_anchors(fps: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, anchor) for all anchors within radius plus ``extra``.

    With ``j`` bits between a fingerprint and the half-way word in one factor, that factor's
    anchor is within 3 + j; the bits of both factors add up to ``extra`` at most.
    """
    word = fps.view(np.uint64)
    a = (word & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    b = ((word >> np.uint64(LENGTH)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    sa, sb, table = syndromes(a), syndromes(b), patterns(extra)
    rows, anchors = [], []
    for ca in range(extra + 1):
        for cb in range(extra + 1 - ca):
            (start_a, n_a, e_a), (start_b, n_b, e_b) = table[ca], table[cb]
            each_b = n_b[sb]
            each = n_a[sa] * each_b
            i = np.repeat(np.arange(len(fps)), each)
            k = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
            da = e_a[start_a[sa[i]] + k // each_b[i]]
            db = e_b[start_b[sb[i]] + k % each_b[i]]
            rows.append(i)
            anchors.append((a[i] ^ da) | (b[i] ^ db) << LENGTH)
    return np.concatenate(rows), np.concatenate(anchors)


def near_words(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the fingerprint, word) for all 64-bit words within ``radius`` bits."""
    flips = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)
    words = (fps.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
    return np.repeat(np.arange(len(fps)), len(flips)), words


def _replicated(fps: DataFrame, near, share: int, name: str) -> DataFrame:
    def run(batch: pa.RecordBatch):
        all_fps = column(batch, "fp").to_numpy()
        for at in range(0, len(all_fps), 2048):
            fp = all_fps[at : at + 2048]
            i, anchor = near(fp, share)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i])], names=[name, "fp"])

    return map_batches(fps, run, f"{name} long, fp long")


# ---- links and groups --------------------------------------------------------


def links(fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between different fingerprints, ``fps`` (fp) being distinct.

    Every pair within ``bits`` bits is linked directly, or, at crowded anchors, over the
    smallest fingerprint around a shared word, which is within ``bits`` bits of both.
    """
    if bits < 2 or bits % 2:
        raise ValueError("an even number of bits is needed")
    near = written(_replicated(fps, near_anchors, bits // 2, "anchor"), "anchors")
    crowded = written(near.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor"), "crowded")
    x = near.join(crowded, "anchor", "left_anti")
    a, b = x.select("anchor", F.col("fp").alias("a")), x.select("anchor", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    found = a.join(b, "anchor").where(close).select("a", "b")
    if not crowded.isEmpty():
        some = near.join(crowded, "anchor", "left_semi").select("fp").distinct()
        around = _replicated(some, near_words, bits // 2, "word").groupBy("word").agg(
            F.min("fp").alias("a"), F.collect_list("fp").alias("all")
        )
        around = around.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b")
        found = found.union(around)
    return found.distinct()


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """A row for each row of ``docs``: doc_id, fingerprint (hex), component_id."""
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = written(links(distinct.select("fp"), bits), "links")
    label = components(found)
    grouped = distinct.join(label, distinct["fp"] == label["node"]).select("fp", "first", "label")
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = written(grouped.select("fp", "label"), "linked").join(written(smallest, "smallest"), "label").select("fp", "component_id")
    alone = distinct.join(label, distinct["fp"] == label["node"], "left_anti").select("fp", F.col("first").alias("component_id"))
    of = written(linked.union(alone), "components")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def file_rows(docs: DataFrame) -> DataFrame | None:
    """``docs`` with the place of each row (_file, _place), if it is read from files as it is or filtered.

    A place is the same in every scan, whatever its splits, so nothing has to be copied to number rows.
    """
    if not docs.inputFiles():
        return None
    file, place = fresh("_file", docs), fresh("_place", docs)
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # a union, an aggregate: no row of it has a place
        return None


def keep_one(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, apart: bool = True, in_place: bool = False) -> DataFrame:
    """One row of each group, all columns kept: that of the smallest doc_id.

    Rows are told apart by a number that is written with them once or, where ``docs`` is read from
    files as it is or filtered (``in_place``), by their places in these files, so that a repeated
    row and a doc_id of several texts are no exception.  A group's rows without a doc_id can't be
    told from its named document: one of them stays beside it, or, unless they are taken ``apart``,
    only where the group has no doc_id at all.

    The texts move once, to meet the rows that stay: by a hashed shuffle at every size, which
    neither sorts them nor depends on how few rows stay.
    """
    rows = file_rows(docs) if in_place else None
    if rows is None:
        rows = written(docs.withColumn(fresh("_place", docs), F.monotonically_increasing_id()), "rows")
    at = rows.columns[len(docs.columns) :]
    d = rows.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(rows["text"]).alias("key"), F.struct(*at).alias("row"), "text")
    prints = written(fingerprints(d, shingle), "fingerprints")
    unnamed = F.col("doc_id").isNull()
    first = F.min(F.struct(unnamed.alias("unnamed"), "doc_id", "key", "row")).alias("first")
    # the first row of a fingerprint, then of its group: no join meets all rows of a group
    firsts = written(prints.groupBy("fp", (unnamed & F.lit(apart)).alias("part")).agg(first), "firsts")
    label = components(written(links(firsts.select("fp").distinct(), bits), "links"))
    group = firsts.join(label, firsts["fp"] == label["node"], "left").select(F.coalesce("label", "fp").alias("group"), "part", "first")
    stay = written(group.groupBy("group", "part").agg(F.min("first").alias("first")).select("first.row.*"), "stay")
    return rows.join(stay.hint("shuffle_hash"), at, "left_semi").drop(*at)
