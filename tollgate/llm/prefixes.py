"""The prefix trie of conversations, by whole-sequence collapse.

Conversations are rebuilt from a shared beginning and their own turns, and identical ones become
one *sequence* with a weight and an end list.  Sequences that are proper prefixes of others go by
anti-join; the rest are the leaves.  Only the sequences' prefixes, weighted, are then aggregated:
a node of the trie is a group of equal prefixes.

A prefix is known by 128 bits: the sums, along the sequence, of hashes of (place, role, text).
Sums are taken in buckets, so a conversation of any length spreads over tasks, and a whole
sequence's sums need no order at all.

Sums over a subtree need no walk through the trie.  A node's members' turns from the node on,
counted with their weights, are differences of the sequences' running code points; each distinct
node counts once less, with the sequence of its smallest member, which owns a *tail* of its own
path.  Both are sums over the sequences through a node.

SHA-256 of an end list is a stream by nature: ids are sorted over all tasks, joined to strings of
bounded size there, and one task reads a node's strings in turn.

Edge cases: null roles and texts are empty ones; turns of one number come in the order of their
hashes (role, text), nulls first, and repeated rows are turns of their own; rows without a conv_id
take no part; conversations without turns end at the root; an empty table gives an empty trie;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import bound_batches, column, written
from tollgate.llm.turns import numbered, pair_hash
from tollgate.operators.running import BUCKET_BITS, running_sums
from tollgate.operators.skew import hot_keys, hot_split_join

FAMILY, SHARED = 100, 6   # conversations of a family, and the beginnings' lengths from 0
SUMS = ["f0", "f1", "f2", "f3"]
PIECE = 1 << 16           # characters of an end list that are joined at a time
LOW = (1 << 32) - 1


def rebuilt(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, n; turns: conv_id, depth from 1, f0 to f3, size), from conv_id, turn, role, text.

    Conversation c takes the first ``crc32(c) % shared`` turns of the first one of its family, then
    its own turns after as many.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    a, b = pair_hash(role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), a.alias("a"), b.alias("b"),
        F.char_length(text).cast("long").alias("size"))
    turns = written(numbered(turns, "conv_id", ["turn", "a", "b"]).drop("turn"), "turns")
    own_size = written(turns.groupBy("conv_id").agg(F.count("*").alias("_n")), "sizes")
    first = F.col("conv_id") - F.col("conv_id") % family
    sizes = own_size.select("conv_id", "_n", first.alias("first"), (F.crc32(F.col("conv_id").cast("string")) % shared).alias("h"))
    of_first = own_size.select(F.col("conv_id").alias("first"), F.col("_n").alias("first_n"))
    sizes = sizes.join(of_first, "first", "left").withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    sizes = written(sizes.select("conv_id", "_n", "first", "h", "taken"), "rebuilt-sizes")
    hot = hot_keys(own_size, "conv_id")
    own = hot_split_join(turns, sizes.select("conv_id", "h", "taken"), "conv_id", hot).where(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "size")
    begin = turns.where(F.col("place") < shared - 1).select(F.col("conv_id").alias("first"), "place", "a", "b", "size")
    begin = sizes.where("taken > 0").select("conv_id", "first", "taken").join(begin, "first").where(F.col("place") < F.col("taken"))
    begin = begin.select("conv_id", (F.col("place") + 1).alias("depth"), "a", "b", "size")
    x, y = pair_hash(F.col("depth"), F.col("a"), F.col("b"))
    parts = [p for v in (x, y) for p in (v.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(v, 32))]
    rows = own.unionByName(begin).select("conv_id", "depth", *[p.alias(f) for f, p in zip(SUMS, parts)], "size")
    length = F.col("taken") + F.greatest(F.col("_n") - F.col("h"), F.lit(0))
    return sizes.select("conv_id", length.alias("n")), written(rows, "rebuilt")


def node(depth: Column, sums: list[Column]) -> Column:
    """A node's key: its depth and the sums of its prefix."""
    return F.concat_ws(":", depth, *sums)


def end_hashes(ends: DataFrame) -> DataFrame:
    """Per key of ``ends`` (key, conv_id): SHA-256 of its ids, ascending, joined by commas."""
    bound_batches(ends.sparkSession)
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first]), pa.array([",".join(ids)])], names=["key", "first", "ids"])

        for b in batches:
            for k, c in zip(column(b, "key").to_pylist(), column(b, "conv_id").to_pylist()):
                if ids and (k != key or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1])
        if ids:
            yield piece()

    pieces = ranged.mapInArrow(join, "key string, first long, ids string").repartition("key").sortWithinPartitions("key", "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(column(b, "key").to_pylist(), column(b, "ids").to_pylist()):
                if k != key:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.mapInArrow(digest, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sizes, turns = rebuilt(conversations, family, shared)
    # whole sequences: sums without an order; identical ones are one, with its weight and smallest conversation
    whole = turns.groupBy("conv_id").agg(*[F.sum(f).alias(f) for f in SUMS], F.sum("size").alias("total"))
    whole = sizes.join(whole, "conv_id", "left").select(
        "conv_id", "n", *[F.coalesce(f, F.lit(0)).alias(f) for f in SUMS], F.coalesce("total", F.lit(0)).alias("total"))
    whole = written(whole.withColumn("key", node(F.col("n"), [F.col(f) for f in SUMS])), "whole")
    sequences = whole.groupBy("key").agg(
        F.min("conv_id").alias("seq"), F.count("*").alias("weight"), F.first("n").alias("n"), F.first("total").alias("total"))
    sequences = written(sequences, "sequences")

    # the prefixes of each sequence, from the root on
    of = sequences.select(F.col("seq").alias("conv_id"), F.col("n").alias("_n"))
    hot = hot_keys(of, "conv_id")
    steps = hot_split_join(turns, of.where("_n > 0"), "conv_id", hot).select(F.col("conv_id").alias("seq"), "depth", *SUMS, "size")
    longest = sequences.agg(F.max("n")).first()[0] or 0
    sums = [*SUMS, "size"]
    if longest >> BUCKET_BITS:
        run = running_sums(steps, "depth", sums, ["seq"], max_order=longest)
    else:  # no sequence has more turns than a bucket holds
        w = Window.partitionBy("seq").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        run = steps.select("*", *[F.sum(c).over(w).alias(f"{c}_through") for c in sums])
    through = [F.col(f"{f}_through") for f in SUMS]
    before = [F.col(f"{f}_through") - F.col(f) for f in SUMS]
    prefixes = run.select(
        "seq", "depth", node(F.col("depth"), through).alias("key"), node(F.col("depth") - 1, before).alias("parent"),
        (F.col("size_through") - F.col("size")).alias("before"))
    zero = [F.lit(0)] * len(SUMS)
    roots = sequences.select("seq", F.lit(0).cast("long").alias("depth"), node(F.lit(0), zero).alias("key"),
                             F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("before"))
    prefixes = written(prefixes.unionByName(roots), "prefixes")

    # leaves: sequences that are no proper prefix of another one
    inner = prefixes.where("parent is not null").groupBy("parent").agg(F.countDistinct("key").alias("n_children"))
    inner = written(inner, "inner")
    leaves = sequences.join(inner, sequences["key"] == inner["parent"], "left_anti").select(F.col("seq").alias("leaf"))
    # the part of its own path that a sequence owns: from the first node whose smallest member it is
    owner = prefixes.groupBy("key").agg(F.min("seq").alias("seq"), F.first("before").alias("before"))
    owned = owner.groupBy("seq").agg(F.min("before").alias("owns_from"))
    facts = sequences.join(leaves, sequences["seq"] == leaves["leaf"], "left").join(owned, "seq", "left").select(
        "seq", "weight", "total", F.col("leaf").isNotNull().cast("long").alias("is_leaf"), F.coalesce("owns_from", "total").alias("owns_from"))
    facts = written(facts, "facts")
    rows = hot_split_join(prefixes, facts, "seq", hot)
    rest = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", "owns_from"))
    nodes = rows.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"),
        F.sum("is_leaf").alias("n_leaves"), F.sum(rest).alias("saved_tokens"))
    nodes = written(nodes, "nodes")

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(
        inner.select("parent", F.col("n_children").alias("_n")), "parent")
    parents = written(parents, "parents")
    placed = hot_split_join(nodes.where("parent is not null"), parents.drop("_n"), "parent", hot_keys(parents, "parent"))
    placed = placed.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    below = parents.select(F.col("parent").alias("key"), F.col("_n").alias("n_children"))
    ends = end_hashes(whole.select("key", "conv_id"))
    return placed.join(below, "key", "left").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: DuckDB SQL for the same rows: prefixes as lists of turns.  Turns of one number come by role and text
#: there, and by their hashes here, so the tables held against it have none.
ORACLE = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS first_id,
    -- CRC-32 of the decimal id: each byte is mixed in, followed by eight single-bit steps (-1)
    (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
        lambda i: list_concat([CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
      lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
taken AS (SELECT i.conv_id, i.h, count(o.place) AS n FROM ids i LEFT JOIN own o ON o.conv_id = i.first_id AND o.place <= i.h GROUP BY ALL),
turns AS (
  SELECT i.conv_id, o.place AS depth, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.first_id AND o.place <= i.h
  UNION ALL
  SELECT t.conv_id, o.place - t.h + t.n, o.role, o.text FROM taken t JOIN own o ON o.conv_id = t.conv_id AND o.place > t.h),
prefixes AS (
  SELECT conv_id, depth, text, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL SELECT conv_id, 0, '', [] FROM ids),
lengths AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(p.text) AS text,
    sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN CAST(p.conv_id AS VARCHAR) END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM prefixes p JOIN lengths l USING (conv_id) GROUP BY p.depth, p.path),
linked AS (SELECT n.*, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.path[:n.depth - 1]),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.path = l.path),
above AS (SELECT depth, path, n_convs, text, n_children, unnest(range(0, depth + 1)) AS d FROM counted),
below AS (
  SELECT d AS depth, path[:d] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * length(text)) AS saved_tokens
  FROM above GROUP BY 1, 2)
SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(c.depth AS BIGINT) AS depth, CAST(c.parent_conv_id AS BIGINT) AS parent_conv_id,
  CAST(c.n_convs AS BIGINT) AS n_convs, CAST(c.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.depth = c.depth AND b.path = c.path
"""
