"""Distributed closed forms against a sequential replay on random inputs."""

import random

from pyspark.sql import functions as F

from tollgate.operators.running import running_sums
from tollgate.operators.summary import batch_sizes, progress_snapshots
from tollgate.operators.unique import assign_batches, classify


def test_running_sums_match_loop(spark):
    rnd = random.Random(7)
    rows = [(i * 3 + rnd.randint(0, 2), rnd.randint(0, 5), rnd.randint(0, 1)) for i in range(20000)]
    df = spark.createDataFrame(rows, "o long, v long, p int")
    got = {r["o"]: r["v_through"] for r in running_sums(df, "o", ["v"], ["p"]).collect()}
    acc = {}
    for o, v, p in sorted(rows):
        acc[p] = acc.get(p, 0) + v
        assert got[o] == acc[p]


import pytest

from tollgate.operators import skew


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 20])
def test_batches_and_duplicate_reason_match_loop(spark, monkeypatch, hot_rows):
    """With hot_rows=20 the heavy emails (one holds a third of the rows) take the map-side path."""
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rnd = random.Random(11)
    emails = [("hot" if rnd.random() < 0.33 else f"e{rnd.randint(0, 300)}") for _ in range(3000)]
    valid = [rnd.random() > 0.2 for _ in range(3000)]
    registered = {f"e{i}" for i in range(0, 300, 17)}
    batch = 50
    df = spark.createDataFrame([(i + 2, e, v) for i, (e, v) in enumerate(zip(emails, valid))],
                               "line_number long, email_value string, is_valid boolean")
    reg = spark.createDataFrame([(e,) for e in registered], "email string")
    classified = classify(assign_batches(df, batch), reg)
    out = {r["line_number"]: (r["batch_no"], r["status"]) for r in classified.collect()}
    snaps = {r["processed"]: (r["imported"], r["errors"]) for r in progress_snapshots(classified, batch, 250).collect()}
    per_batch = {r["batch_no"]: r["inserted"] for r in batch_sizes(classified).collect()}
    # sequential replay of the reference's loop
    stored, pending, expected, n_valid = set(registered), [], {}, 0
    imported = errors = 0
    exp_snaps, exp_batches = {}, {}

    def flush():
        nonlocal imported, errors
        seen = set()
        for line, e in pending:
            if e in stored:
                expected[line] = "existing"
                errors += 1
            elif e in seen:
                expected[line] = "file"
                errors += 1
            else:
                seen.add(e)
                expected[line] = "unique"
        if pending:
            exp_batches[(n_valid - 1) // batch] = len(seen)
        imported += len(seen)
        stored.update(seen)
        pending.clear()

    for i, (e, v) in enumerate(zip(emails, valid)):
        line = i + 2
        assert out[line][0] == n_valid // batch
        if v:
            pending.append((line, e))
            n_valid += 1
            if len(pending) >= batch:
                flush()
        else:
            expected[line] = "invalid"
            errors += 1
        if (i + 1) % 250 == 0:
            exp_snaps[i + 1] = (imported, errors)
    flush()
    assert {k: v[1] for k, v in out.items()} == expected
    assert snaps == exp_snaps
    assert per_batch == exp_batches


def test_order_inversions_match_loop(spark):
    from tollgate.operators.inversions import order_inversions

    rnd = random.Random(5)
    orders = sorted(rnd.sample(range(200000), 12000))  # gaps in the insert order
    keys = [rnd.randint(0, 50) if rnd.random() < 0.3 else i for i in range(12000)]
    df = spark.createDataFrame(list(zip(orders, keys)), "o long, k long")
    got = order_inversions(df, "o", {"inv": "k"}).collect()[0]["inv"]
    assert got == sum(1 for a, b in zip(keys, keys[1:]) if b < a)


def test_two_level_running_sums_with_bound(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randint(0, 3)) for i in range(50000)]
    df = spark.createDataFrame(rows, "o long, v long")
    got = {r["o"]: r["v_through"] for r in running_sums(df, "o", ["v"], max_order=50000).collect()}
    acc = 0
    for o, v in rows:
        acc += v
        assert got[o] == acc


@pytest.mark.parametrize("bound", [None, 30000])
def test_persisted_running_sums_match_loop_and_release(spark, bound):
    """``persist=True``: same sums on both level paths, and the cached shuffle is handed back."""
    rnd = random.Random(11)
    rows = [(i * 2 + rnd.randint(0, 1), rnd.randint(0, 4), rnd.randint(0, 2)) for i in range(15000)]
    df = spark.createDataFrame(rows, "o long, v long, p int")
    out = running_sums(df, "o", ["v"], ["p"], max_order=bound, persist=True)
    cached = out._tollgate_cached
    assert len(cached) == 1 and cached[0].is_cached
    got = {r["o"]: r["v_through"] for r in out.collect()}
    acc = {}
    for o, v, p in sorted(rows):
        acc[p] = acc.get(p, 0) + v
        assert got[o] == acc[p]
    cached[0].unpersist()
    assert not cached[0].is_cached
