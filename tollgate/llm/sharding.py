"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text are one group with a size vector (bytes, tokens, rows) relative to a
shard's capacity, which is the total by the number of shards.  Groups are placed largest
first, each on the shard, of those it fits in, where the dot product of its size and the
shard's residual capacity is highest; where it fits nowhere the most bytes must remain.

* A group beyond ``WHOLE`` of a shard in any dimension is split into parts of at most half of
  that (a third of all rows may be copies of one text; no shard could hold them).
* Items beyond ``LARGE`` of a shard are at most 3 * n_shards / LARGE, whatever the input; they
  are placed first, in one place.
* All others are dealt out to blocks of about ``BLOCK``.  Each block gets its share of every
  shard's residual capacity and is packed on its own; afterwards single items are swapped
  between a block's fullest and emptiest shard until their bytes are level.

The law is ``bytes``: shard sizes are nearly equal, up to a block's smallest items.

Tokens are counted as spaces plus one, for balance only.  Edge cases: a null text has 16 bytes
like an empty one but is a group of its own; rows with null or repeated doc_id are rows like any
other; ties go to the lower shard; an empty table gives an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tollgate.llm.common import bound_batches, written

SHARDS = 40
OVERHEAD = 16           # bytes of a row besides its text
WHOLE = 0.5             # of a shard: larger groups are split
LARGE = 0.125           # of a shard: larger items are placed before all others
BLOCK = 1 << 15         # items placed together
STRETCH = 1 << 16       # rows numbered together
SWAPS = 400             # exchanges that level a block
DIMENSIONS = ("bytes", "tokens", "rows")


def place(sizes: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A shard for each item; ``residual`` (shards x dimensions) is used up.  Both relative to a capacity."""
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes.max(axis=1), kind="stable"):
        v = sizes[i]
        fits = (residual >= v).all(axis=1)
        s = int(np.argmax(np.where(fits, residual @ v, -np.inf))) if fits.any() else int(np.argmax(residual[:, 0]))
        out[i] = s
        residual[s] -= v
    return out


def level(sizes: np.ndarray, shard: np.ndarray, residual: np.ndarray, swaps: int = SWAPS) -> None:
    """Swap one item for one between the fullest and the emptiest shard while that evens their bytes."""
    size = sizes[:, 0]
    for _ in range(swaps):
        a, b = int(np.argmin(residual[:, 0])), int(np.argmax(residual[:, 0]))
        half = (residual[b, 0] - residual[a, 0]) / 2
        xs, ys = np.flatnonzero(shard == a), np.flatnonzero(shard == b)
        if not len(xs) or not len(ys):
            break
        ys = ys[np.argsort(size[ys], kind="stable")]
        # for each x the y that comes nearest to moving half of the difference
        at = np.searchsorted(size[ys], size[xs] - half)
        best = (np.inf, 0, 0)
        for near in (np.clip(at - 1, 0, len(ys) - 1), np.clip(at, 0, len(ys) - 1)):
            off = np.abs(size[xs] - size[ys[near]] - half)
            k = int(np.argmin(off))
            best = min(best, (float(off[k]), int(xs[k]), int(ys[near[k]])))
        off, x, y = best
        if off >= half * 0.999 or half <= 0:
            break
        moved = sizes[x] - sizes[y]
        shard[x], shard[y] = b, a
        residual[a] += moved
        residual[b] -= moved


def assign(items: DataFrame, n_shards: int) -> DataFrame:
    """``items`` (with bytes, tokens and rows, at least one of each) with a shard."""
    spark = items.sparkSession
    bound_batches(spark)
    sums = items.agg(F.count("*").alias("n"), *(F.sum(d).alias(d) for d in DIMENSIONS)).first()
    if not sums["n"]:
        return items.withColumn("shard", F.lit(0))
    total = np.array([float(sums[d]) for d in DIMENSIONS])
    cap = total / n_shards
    residual = np.ones((n_shards, len(DIMENSIONS)))
    is_large = F.greatest(*(F.col(d) / F.lit(float(c)) for d, c in zip(DIMENSIONS, cap))) > LARGE
    large = items.where(is_large).orderBy(*DIMENSIONS, "g", "part").collect()  # at most 3 * n_shards / LARGE
    sizes = np.array([[r[d] for d in DIMENSIONS] for r in large], float).reshape(-1, len(DIMENSIONS)) / cap
    shards = place(sizes, residual)
    schema = T.StructType([*items.schema.fields, T.StructField("shard", T.IntegerType())])
    placed = spark.createDataFrame([(*(r[c] for c in items.columns), int(s)) for r, s in zip(large, shards)], schema)
    rest_n, rest = sums["n"] - len(large), np.maximum(n_shards - sizes.sum(axis=0), 1e-12)
    blocks = max(1, round(rest_n / BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        v = np.stack([t.column(d).to_numpy().astype(float) for d in DIMENSIONS], axis=1) / cap
        own = residual * (v.sum(axis=0) / rest)
        shard = place(v, own)
        level(v, shard, own)
        yield from t.append_column("shard", pa.array(shard, pa.int32())).to_batches(max_chunksize=10_000)

    dealt = items.where(~is_large).repartition(blocks).mapInArrow(run, schema)
    return dealt.unionByName(placed)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long").alias("tokens"),
            F.coalesce(F.unhex(F.md5("text")), F.lit(b"")).alias("g"), F.monotonically_increasing_id().alias("rid"),
        ),
        "rows",
    )
    n, size, tokens = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    measure = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = rows.groupBy("g").agg(*measure)
    share = F.greatest(*(F.col(d) * n_shards / F.lit(float(t or 1)) for d, t in zip(DIMENSIONS, (size, tokens, n))))
    # groups beyond WHOLE of a shard: at most 3 * n_shards / WHOLE
    split = groups.withColumn("share", share).where(F.col("share") > WHOLE).select("g", F.ceil(F.col("share") * 2 / WHOLE).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(split), "g", "left").withColumn("part", part).drop("parts")
    items = written(rows.groupBy("g", "part").agg(*measure), "items")
    chosen = written(assign(items, n_shards).select("g", "part", "shard"), "shards")

    stretches = max(16, math.ceil((n or 0) / STRETCH))
    out = rows.join(chosen, ["g", "part"]).withColumn("stretch", F.pmod(F.xxhash64("rid"), F.lit(stretches)))
    out = written(out.select("doc_id", "size", "text_crc32", "shard", "stretch", "rid"), "sharded")
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    first = out.groupBy("shard", "stretch").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("shard", "stretch").orderBy("rid")) - 1
    numbered = out.withColumn("within", within).join(first, ["shard", "stretch"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
