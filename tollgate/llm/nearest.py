"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one member, which keeps the ``k + 1`` smallest ids of its rows (more can't be
among k results).  Members of one direction, whatever their lengths, are one point: the cell of
a grid of 1 / ``GRID`` that their unit vectors fall into.  A point of up to ``INLINE`` members
carries them; those of others are in a written table, dealt out in blocks.  Points are dealt out
by hash to shards of about ``SHARD``.  In a shard every point is inserted:

* a greedy search for it proposes neighbours: the points it met;
* relaxed distance pruning keeps the nearest and drops each proposal to which a kept one is
  nearer by the factor ``ALPHA`` than the point itself, so that edges lead in diverse
  directions, ``DEGREE`` at most;
* kept neighbours get an edge back and are pruned in turn;
* a point that no path leads to in the end gets an edge from the nearest one that has a path.

The graphs are written as the index.  Queries, in blocks of about ``QUERIES``, go to every
shard; a beam search of width ``BEAM`` gives each shard's nearest points.  The cosines of their
members are worked out in double precision on the original vectors, from the nearest point on
until the next can't have a better one; queries that meet a point with a table of members are
held against all its blocks.  The best of all are the answer.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part,
neither as queries nor as candidates; nor do rows without a vec_id; vectors of another length
are no candidates; rows that repeat a vec_id count once; ties go to the smaller vec_id; queries
without candidates have no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tollgate.llm.common import bound_batches, column, map_batches, written

SHARD = 4096            # points of a graph
DEGREE = 28             # edges out of a point
BUILD_BEAM = 64         # width of the searches that propose neighbours
BEAM = 96               # width of the searches that answer queries
ALPHA = 1.2
QUERIES = 4096          # queries that a task answers on one shard
GRID = 1 << 14          # steps of a unit vector's part, for what counts as one direction
INLINE = 32             # members that a point carries itself
MEMBERS = 4096          # members of a point that a task holds against queries


# ---- one shard's graph -------------------------------------------------------


def beam_search(x: np.ndarray, edges: list[list[int]], start: int, q: np.ndarray, width: int) -> tuple[list[tuple[float, int]], list[tuple[float, int]]]:
    """(the ``width`` nearest points met, all points whose edges were followed) as (-dot, point)."""
    first = -float(x[start] @ q)
    todo, best, seen, followed = [(first, start)], [(-first, start)], {start}, []
    while todo:
        d, u = heapq.heappop(todo)
        if len(best) >= width and d > -best[0][0]:
            break
        followed.append((d, u))
        new = [v for v in edges[u] if v not in seen]
        if not new:
            continue
        seen.update(new)
        for v, dv in zip(new, (-(x[new] @ q)).tolist()):
            if len(best) < width:
                heapq.heappush(best, (-dv, v))
                heapq.heappush(todo, (dv, v))
            elif dv < -best[0][0]:
                heapq.heapreplace(best, (-dv, v))
                heapq.heappush(todo, (dv, v))
    return sorted((-d, v) for d, v in best), followed


def prune(x: np.ndarray, p: int, proposals: list[int], degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """The diverse neighbours of p among the proposals, nearest first."""
    c = np.array([v for v in dict.fromkeys(proposals) if v != p], np.int64)
    if not len(c):
        return []
    to_p = np.sqrt(np.maximum(0, 2 - 2 * (x[c] @ x[p])))
    order = np.argsort(to_p, kind="stable")
    c, to_p = c[order], to_p[order]
    between = np.sqrt(np.maximum(0, 2 - 2 * (x[c] @ x[c].T))) * alpha
    alive = np.ones(len(c), bool)
    kept = []
    for k in range(len(c)):
        if alive[k]:
            kept.append(int(c[k]))
            if len(kept) == degree:
                break
            alive &= between[k] > to_p
    return kept


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[list[list[int]], int]:
    """(edges, start) of a graph over unit vectors; points go in in a fixed shuffled order."""
    n = len(x)
    start = int(np.argmax(x @ x.mean(axis=0)))
    edges: list[list[int]] = [[] for _ in range(n)]
    for p in np.random.default_rng(n).permutation(n).tolist():
        if p == start:
            continue
        _, met = beam_search(x, edges, start, x[p], beam)
        edges[p] = prune(x, p, [v for _, v in met], degree, alpha)
        for v in edges[p]:
            if p not in edges[v]:
                edges[v].append(p)
                if len(edges[v]) > degree + degree // 2:
                    edges[v] = prune(x, v, edges[v], degree, alpha)
    connect(x, edges, start, beam)
    return edges, start


def connect(x: np.ndarray, edges: list[list[int]], start: int, beam: int) -> None:
    """Give each point without a path from the start an edge from the nearest that a search for it meets."""
    reached: set[int] = set()

    def follow(p: int) -> None:
        reached.add(p)
        todo = [p]
        while todo:
            new = set(edges[todo.pop()]) - reached
            reached.update(new)
            todo += new

    follow(start)
    for p in range(len(x)):
        if p not in reached:
            edges[beam_search(x, edges, start, x[p], beam)[0][0][1]].append(p)
            follow(p)


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


# ---- Spark -------------------------------------------------------------------


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda e: e != 0)


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def cells(points: DataFrame) -> DataFrame:
    """``points`` (vector, ids) with dim and cell, the direction's place on the grid."""

    def run(batch: pa.RecordBatch):
        out = []
        for v in column(batch, "vector"):
            v = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)
            v /= np.abs(v).max()
            out.append(np.rint(v / np.linalg.norm(v) * GRID).astype("<i2").tobytes())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "vector"), column(batch, "ids"), pa.array([len(c) // 2 for c in out], pa.int32()), pa.array(out, pa.binary())],
            names=["vector", "ids", "dim", "cell"],
        )

    return map_batches(points.select("vector", "ids"), run, "vector array<double>, ids array<long>, dim int, cell binary")


def centres(cell: list[bytes]) -> np.ndarray:
    return unit(np.frombuffer(b"".join(cell), "<i2").reshape(len(cell), -1).astype(np.float64))


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(index, members): dim, shard, point, cell, ids (a list for each member, the smallest k + 1), vectors (one
    after the other), edges, start for each direction; cell, block, ids, vector for those with many members."""
    v = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    # only the smallest ids of a vector leave a task
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    same = v.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    same = written(cells(same.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))), "members")
    of = written(same.groupBy("dim", "cell").agg(F.count("*").alias("of")), "cells")
    many = written(of.where(F.col("of") > INLINE).select("cell", F.ceil(F.col("of") / MEMBERS).cast("int").alias("blocks")), "many")
    members = same.join(many, "cell").withColumn("block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int"))
    members = written(members.select("cell", "block", "blocks", "ids", "vector"), "crowds")
    few = same.join(many, "cell", "left_anti").groupBy("dim", "cell").agg(F.collect_list(F.struct("ids", "vector")).alias("m"))
    few = few.select("dim", "cell", F.col("m.ids").alias("ids"), F.flatten("m.vector").alias("vectors"))
    none = [F.array().cast(t).alias(c) for t, c in (("array<array<bigint>>", "ids"), ("array<double>", "vectors"))]
    points = written(few.unionByName(of.where(F.col("of") > INLINE).select("dim", "cell", *none)), "points")
    sizes = {r.dim: r["count"] for r in points.groupBy("dim").count().collect()}  # a row per length of vectors
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, F.lit(max(1, round(n / shard)))).otherwise(shards)
    graphs = sum(max(1, round(n / shard)) for n in sizes.values())
    points = points.withColumn("shard", F.pmod(F.xxhash64("cell"), shards).cast("int"))
    bound_batches(vectors.sparkSession)

    def graph(key, t):
        edges, start = build(centres(t.column("cell").to_pylist()))
        n = t.num_rows
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()] * n, pa.int32()), "shard": t.column("shard"), "point": pa.array(range(n), pa.int32()),
                "cell": t.column("cell"), "ids": t.column("ids"), "vectors": t.column("vectors"),
                "edges": pa.array(edges, pa.list_(pa.int32())), "start": pa.array([start] * n, pa.int32()),
            }
        )

    schema = "dim int, shard int, point int, cell binary, ids array<array<long>>, vectors array<double>, edges array<int>, start int"
    # a shard is much work on few bytes: by a given number, so that adaptive execution doesn't put them together
    points = points.repartition(max(1, 2 * graphs), "dim", "shard")
    return written(points.groupBy("dim", "shard").applyInArrow(graph, schema), "index"), members


def cosines(exact: np.ndarray, norms: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (exact * v).sum(axis=1) / (norms * math.sqrt(float((v * v).sum())))


FOUND = "query_id long, vec_id long, score double, cell binary, vector array<double>"


def _found(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.float64())]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "vec_id", "score", "cell", "vector"])


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, beam: int = BEAM, block: int = QUERIES) -> DataFrame:
    """The k nearest of ``index`` for each row of ``queries`` (vec_id, embedding): query_id, rank, vec_id, score."""
    index, members = index
    q = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    q = q.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).distinct()
    q = written(q.withColumn("dim", F.size("vector")), "queries")
    blocks = max(1, math.ceil(q.count() / block))
    shards = written(index.select("dim", "shard").distinct(), "graphs")
    asked = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).join(shards, "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    bound_batches(index.sparkSession)

    def answer(key, points, questions):
        out: list[tuple] = []
        if points.num_rows and questions.num_rows:
            dim = key[0].as_py()
            points = points.sort_by("point")
            cell, ids = points.column("cell").to_pylist(), points.column("ids").to_pylist()
            exact, asked_for = _matrix(points.column("vectors"), dim), _matrix(questions.column("vector"), dim)
            ends = np.cumsum([len(m) for m in ids])
            x, edges, start = centres(cell), points.column("edges").to_pylist(), points.column("start")[0].as_py()
            norms = np.sqrt((exact * exact).sum(axis=1))
            slack = math.sqrt(dim) / GRID + 1e-5  # between a point's cosine and those of its members
            for name, v, u in zip(questions.column("query_id").to_pylist(), asked_for, unit(asked_for)):
                found: list[tuple[float, int]] = []
                for d, p in beam_search(x, edges, start, u, beam)[0]:
                    if len(found) == k and d - slack > found[-1][0]:
                        break
                    if ids[p]:
                        at = slice(int(ends[p]) - len(ids[p]), int(ends[p]))
                        score = cosines(exact[at], norms[at], v).tolist()
                        found = sorted(found + [(-s, i) for s, m in zip(score, ids[p]) for i in m if i != name])[:k]
                    else:
                        out.append((name, None, None, cell[p], v))
                out += [(name, i, -s, None, None) for s, i in found]
        return _found(out)

    def rank_members(key, crowd, questions):
        out: list[tuple] = []
        if crowd.num_rows and questions.num_rows:
            dim = len(key[0].as_py()) // 2
            exact, ids = _matrix(crowd.column("vector"), dim), crowd.column("ids").to_pylist()
            norms = np.sqrt((exact * exact).sum(axis=1))
            least = np.array([m[0] for m in ids])
            for name, v in zip(questions.column("query_id").to_pylist(), _matrix(questions.column("vector"), dim)):
                score = cosines(exact, norms, v)
                top = np.lexsort((least, -score))[: k + 1]  # one of them may be the query itself
                found = sorted((-s, i) for s, p in zip(score[top].tolist(), top.tolist()) for i in ids[p] if i != name)[:k]
                out += [(name, i, -s, None, None) for s, i in found]
        return _found(out)

    keys = ("dim", "shard", "block")
    tasks = max(1, 2 * blocks * shards.count())
    held, asked = held.repartition(tasks, *keys), asked.repartition(tasks, *keys)
    near = written(held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(answer, FOUND), "near")
    met = near.where("cell is not null").select("query_id", "cell", "vector").distinct()
    near = near.where("cell is null")
    if not members.isEmpty():
        per_cell = met.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
        of = written(per_cell.join(members.select("cell", "blocks").distinct(), "cell"), "met")
        met = met.join(of, "cell").withColumn("part", F.pmod(F.xxhash64("query_id", "vector"), F.col("parts")).cast("int"))
        met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "block", "part", "query_id", "vector")
        crowd = members.join(of.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        crowd = crowd.select("cell", "block", "part", "ids", "vector")
        keys = ("cell", "block", "part")
        near = near.unionByName(crowd.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(rank_members, FOUND))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = near.select("query_id", "vec_id", "score").distinct()
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    return search(build_index(vectors, k), queries, k)
