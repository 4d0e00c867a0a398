"""Best-fit packing of token pieces into sequences, improved by a swap-based local search.

``encode_pieces`` turns each text into token ids plus an end id and cuts only documents that
are longer than a sequence.  ``pack`` deals the pieces out to blocks of about ``BLOCK`` pieces
and packs each block on its own: a block's waste is less than a sequence or two, however many
blocks there are.  Within a block:

* best fit, longest pieces first: a piece goes where the least room remains;
* then bins that aren't full exchange pieces -- move one, one for one, two for one, one for
  two -- whenever that raises the sum of squared fills, so full bins get fuller and the
  emptiest ones run dry; it ends when the bins are as few as their total allows or when no
  exchange helps.

Only lengths and checksums are shuffled unless ids are asked for.  Edge cases: a null or
empty text is the end id alone; rows with a null or repeated doc_id are packed like any
other, row by row; ties go to the earlier piece of a block; an empty table gives no
sequence; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tollgate.llm.common import bound_batches, byte_texts, column, map_batches, written

CAPACITY = 2048
BLOCK = 1 << 16         # pieces packed together
MEMO = 1 << 19          # chunks remembered per worker, and as many older ones
MEMO_BYTES = 48         # longer chunks are not split and not kept
GROUP = 1 << 22         # bytes whose new chunks are encoded together
PASSES = 24             # rounds of the local search

# A letter and other visible ASCII are never in one token of this kind of vocabulary.
PARTS = re.compile(rb"(?<=[a-z])(?=[!-@\[-`{-~])")


class ChunkIds:
    """Token ids of whole texts, chunk by chunk, for vocabularies that drop white space.

    The library encodes each new chunk once; texts are put together from remembered chunks.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def learn(self, chunks: set[bytes]) -> None:
        if len(self.memo) > MEMO:  # what is in use comes back from the older half
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        whole = lambda c: len(c) > MEMO_BYTES or b"<|" in c  # noqa: E731  a special string stays in one
        parts: dict[bytes, list[bytes]] = {}
        for c in chunks.difference(memo):
            known = older.get(c)
            if known is None:
                parts[c] = [c] if whole(c) else PARTS.split(c)
            else:
                memo[c] = known
        wanted = []
        for p in set(itertools.chain.from_iterable(parts.values())).difference(memo):
            known = older.get(p)
            if known is None:
                wanted.append(p)
            else:
                memo[p] = known
        if wanted:
            e = self.tok.encode([w.decode() for w in wanted], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            ends = np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(wanted)), "right").tolist()
            for w, a, b in zip(wanted, [0, *ends], ends):
                memo[w] = ids[a:b].tobytes()
        for c, ps in parts.items():
            if len(ps) > 1:
                memo[c] = b"".join(map(memo.__getitem__, ps))

    def encode(self, batch: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        at = 0
        while at < len(batch):
            rows, size = [], 0
            while at < len(batch) and (not rows or size + len(batch[at]) <= GROUP):
                t = batch[at]
                rows.append((t if b"<|" in t else t.lower()).split())  # special strings are case-sensitive
                size += len(t)
                at += 1
            self.learn(set().union(*rows))
            for chunks in rows:
                yield b"".join(map(self.memo.__getitem__, chunks))
            for c in {c for chunks in rows for c in chunks if len(c) > MEMO_BYTES}:
                self.memo.pop(c, None)


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkIds:
    return ChunkIds(path)


def encode_pieces(
    docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, as little-endian 32-bit numbers)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch):
        out: list[tuple] = []
        for doc, ids in zip(column(batch, "doc_id").to_pylist(), encoder(vocab_path).encode(byte_texts(batch))):
            ids += end
            for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[a : a + 4 * capacity]
                out.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        keep = 6 if with_ids else 5
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names=names[:keep])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_batches(docs.select("doc_id", "text"), run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each where the least room remains."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has r left
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = size[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        if r > n:
            room[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def local_search(bins: list[list[int]], size: list[int], capacity: int, passes: int = PASSES) -> list[list[int]]:
    """Exchange items between bins that aren't full while that raises the sum of squared fills."""
    full = [b for b in bins if sum(size[i] for i in b) == capacity]
    loose = [b for b in bins if sum(size[i] for i in b) < capacity]
    least = math.ceil(sum(size[i] for b in loose for i in b) / capacity)
    for _ in range(passes):
        if len(loose) <= least:
            break
        loose.sort(key=lambda b: -sum(size[i] for i in b))
        fill = [sum(size[i] for i in b) for b in loose]
        # every single item and every pair of one bin, by size: what a bin can give
        gifts = sorted(
            (size[i] + (size[j] if j >= 0 else 0), k, i, j)
            for k, b in enumerate(loose)
            for i, j in itertools.chain(((i, -1) for i in b), itertools.combinations(b[:12], 2))
        )
        sizes = np.array([g[0] for g in gifts], np.int64)
        used: set[int] = set()
        changed = False
        for k, b in enumerate(loose):
            if k in used or fill[k] == capacity:
                continue
            gap, best = capacity - fill[k], None
            # what it gives back: nothing, one of its own or two of its own
            back = [((), 0), *(((i,), size[i]) for i in b), *((p, size[p[0]] + size[p[1]]) for p in itertools.combinations(b[:12], 2))]
            for own, lost in back:
                at = int(np.searchsorted(sizes, lost + gap, "right")) - 1
                for g in range(at, max(-1, at - 40), -1):
                    n, other, i, j = gifts[g]
                    d = n - lost
                    if d <= 0 or best and d <= best[0]:
                        break
                    if other == k or other in used or len(own) == 2 and j >= 0 or fill[k] + d <= fill[other]:
                        continue
                    best = (d, own, other, i, j)
                    break
            if best:
                d, own, other, i, j = best
                got = {i, j} - {-1}
                loose[k] = [x for x in b if x not in own] + sorted(got)
                loose[other] = [x for x in loose[other] if x not in got] + list(own)
                fill[k] += d
                fill[other] -= d
                used |= {k, other}
                changed = True
        loose = [b for b in loose if b]
        if not changed:
            break
    return full + loose


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths.tolist(), capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """The pieces with sequence_id and offset.  ``pieces`` should be cheap to read twice."""
    bound_batches(pieces.sparkSession)
    parts = max(1, round(pieces.count() / block))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [])
        lengths = held.column("length").to_numpy().astype(np.int64)
        order, seq, offset = [], [], []
        first = TaskContext.get().partitionId() << 32
        for s, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                order.append(i)
                seq.append(first + s)
                offset.append(at)
                at += int(lengths[i])
        out = held.take(pa.array(order, pa.int64()))
        out = out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from out.to_batches(max_chunksize=10_000)

    def guarded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            yield from run(itertools.chain([first], batches))

    return pieces.repartition(parts).mapInArrow(guarded, schema)


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack whole documents; one row per piece."""
    pieces = written(encode_pieces(docs, vocab_path, capacity, end_id, with_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pieces packed ``with_ids`` (at most a capacity of them)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
