"""Pruned graphs: recall against brute force, exact scores, edge cases."""

import math

import numpy as np

from tollgate.llm import nearest


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        found = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                s = float(np.dot(np.array(v, float), np.array(w, float)) / math.sqrt(np.dot(v, v)) / math.sqrt(np.dot(w, w)))
                found.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def run(spark, rows, queries, k=5):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    q = spark.createDataFrame([(*r, 1, "x") for r in queries], "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in sorted(nearest.nearest(df, q, k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 400)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32)).astype(np.float32).tolist()) for i in range(1500)]
    queries = rows[::20]
    want = brute(rows, queries, 5)
    got = run(spark, rows, queries)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    exact = {(q, i): s for q, all_of in brute(rows, queries, 1500).items() for i, s in all_of}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, found in got.items() for i, s in found)
    assert all(found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found) for q, found in got.items())


def test_edge_cases(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(100, [0.0, 2.0]), (101, [0.0, -2.0]), (102, None), (103, [0.0, 0.0]),
            (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [None, 1.0]), (107, []), (108, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
            (100, [0.0, 2.0]), (200, [3.0, 0.0])]
    queries = [r for r in rows if r[0] in (7, 20, 100, 102, 103, 104, 108, 200, None)]
    got = run(spark, rows, queries)
    assert [i for i, _ in got[7]] == [0, 1, 2, 3, 4] and [i for i, _ in got[20]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[200]] == [0, 1, 2, 3, 4]
    assert [i for i, _ in got[100]] == [0, 1, 2, 3, 4] and set(got) == {7, 20, 100, 200}  # 108 has no partner


def test_fewer_candidates_and_empty(spark):
    got = run(spark, [(1, [1.0, 0.0]), (2, [1.0, 1.0])], [(1, [1.0, 0.0])])
    assert [i for i, _ in got[1]] == [2]
    assert run(spark, [], []) == {}


def test_pruning_keeps_diverse_edges():
    x = nearest.unit(np.array([[1, 0], [1, 0.1], [1, 0.11], [0, 1.0], [1, -0.5]]))
    kept = nearest.prune(x, 0, [1, 2, 3, 4])
    assert kept[0] == 1 and 2 not in kept and 4 in kept


def test_a_third_of_the_rows_in_one_direction(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD", 600)
    monkeypatch.setattr(nearest, "MEMBERS", 64)
    monkeypatch.setattr(nearest, "QUERIES", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=16)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(800)]
    rows += [(1000 + i, (v * (1 + i)).astype(np.float32).tolist()) for i in range(400)]
    queries = rows[800::20] + rows[:800:80] + [(5000, (v + 0.01 * rng.normal(size=16)).astype(np.float32).tolist())]
    want, got = brute(rows, queries, 5), run(spark, rows, queries)
    scores = lambda found: [round(s, 12) for _, s in found]
    hits = sum(scores(got[q]) == scores(want[q]) for q in want if q >= 1000)
    assert hits == 21
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want if q < 1000) >= 0.9 * 50


def test_every_point_is_reached():
    rng = np.random.default_rng(6)
    x = nearest.unit(np.concatenate([rng.normal(size=(300, 8)), np.ones((150, 8)) + 1e-9 * rng.normal(size=(150, 8))]))
    edges, start = nearest.build(x)
    seen, todo = {start}, [start]
    while todo:
        new = set(edges[todo.pop()]) - seen
        seen |= new
        todo += new
    assert len(seen) == len(x)
