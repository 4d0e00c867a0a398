"""SimHash groups against brute force; the covering code; edge cases."""

import re

import numpy as np
import pytest
import xxhash

from tollgate.llm import simhash


def brute_fingerprint(text, shingle=3):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(ids, fps, bits=2):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    smallest = {}
    for i, d in enumerate(ids):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return [smallest.get(root(i)) for i in range(len(ids))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int, anchor string")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = list(zip([r[0] for r in rows], (f"{f:016x}" for f in fps), brute_groups([r[0] for r in rows], fps)))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edge_cases_and_near_copies(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(200)]
    rows = [(3, None), (1, ""), (7, " \t\n"), (9, "One"), (10, "one"), (11, "one two"), (None, "lone words only here"),
            (12, "Ä ä"), (13, "ä ä"), (14, "a " * 30_000)]
    for d in range(100, 160):
        words = rng.choice(vocab, 80).tolist()
        rows.append((d, " ".join(words)))
        for k in range(rng.integers(0, 4)):
            near = words.copy()
            near[rng.integers(0, 80)] = "changed"
            rows.append((int(1000 * (k + 1) + d), " ".join(near)))
    rows += [rows[20], rows[20]]
    check(spark, [(*r, "x", 1, "y") for r in rows])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_one(df).collect() == []


def test_anchors_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    y = x.copy()
    for _ in range(2):
        y ^= (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)).view(np.int64)
    sets = []
    for f in (x, y):
        row, anchor = simhash.near_anchors(f, 1)
        s = [set() for _ in f]
        for i, a in zip(row.tolist(), anchor.tolist()):
            s[i].add(a)
        sets.append(s)
    assert all(a & b for a, b in zip(*sets))


@pytest.mark.parametrize("crowd", [2, 512])
def test_links_join_what_brute_force_joins(spark, crowd):
    """Crowded anchors or not: the same groups, and no link beyond the threshold."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**62))
    fps = {base}
    for _ in range(150):
        f = base
        for _ in range(rng.integers(0, 6)):
            f ^= 1 << int(rng.integers(0, 63))
        fps.add(f)
    fps = sorted(fps)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd=crowd).collect()
    assert all((r.a ^ r.b).bit_count() <= 2 for r in found)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for r in found:
        parent[root(r.a)] = root(r.b)
    groups = brute_groups(fps, fps)
    by_root = {}
    for f, g in zip(fps, groups):
        by_root.setdefault(g, set()).add(root(f))
    assert all(len(s) == 1 for s in by_root.values()) and len({root(f) for f in fps}) == len(by_root)


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e", "en"), (2, "a b c d e", "de"), (3, "quite another text here", None), (None, "a b c d e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3]
