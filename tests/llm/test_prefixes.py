"""The prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest
import xxhash

from tollgate.llm import prefixes, turns
from tollgate.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def order(turn, role, text):
    """Turns of one number by their hashes."""
    role, text = role or "", text or ""
    a = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return (turn is not None, turn or 0, signed(a), role, text)


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((order(turn, role, text), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + t[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    out = []

    def below(p):  # (leaves, saved) of the subtree
        kids = children.get(p, [])
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        found = [below(k) for k in kids]
        return (sum(x for x, _ in found) or 1, saved + sum(y for _, y in found))

    for p, m in members.items():
        leaves, saved = below(p)
        ends = sorted(c for c in m if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved,
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = prefixes.prefix_trie(df)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def random_rows(seed, n, words=("a", "b", "cc", "", None), longest=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(0, 320), rng.randint(-150, 10), 100, 200])
        for t in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", "user", None]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 120)
    check(spark, rows + [(None, 1, "user", "nobody's"), (None, None, None, None)] + rows[:9])


def test_hot_beginnings_copies_and_one_long_conversation(spark, monkeypatch):
    """A third of the conversations are copies, a third of the turns belong to one; hot keys are split."""
    monkeypatch.setattr("tollgate.operators.skew.HOT_ROWS", 20)
    rows = [(c, t, r, x) for c in range(1000, 1120) for t, (r, x) in enumerate([("user", "same"), ("assistant", "héé"), ("user", "end")])]
    rows += [(5, t, "user", f"turn {t % 3}") for t in range(500)] + random_rows(4, 40)
    check(spark, rows)


def test_more_turns_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "BUCKET_BITS", 2)
    monkeypatch.setattr("tollgate.operators.running.BUCKET_BITS", 2)
    check(spark, random_rows(5, 30, longest=30))


def test_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 5)
    check(spark, random_rows(6, 60, words=("a", "b")))


def test_no_turns_and_no_rows(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    # 301 has fewer turns than it would share and no first one of its family: it ends at the root
    lone = next(c for c in range(301, 400) if zlib.crc32(str(c).encode()) % 6 > 2)
    check(spark, [(lone, 0, "user", "x"), (lone, 1, "user", "x")])
    check(spark, [(lone, 0, "user", "x"), (7, 0, None, "long " * 50_000), (7, 0, None, "long " * 50_000)])


def test_other_columns_are_not_read(spark):
    rows = random_rows(7, 30)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", depth int, key string")
    assert sorted((tuple(r) for r in prefixes.prefix_trie(df).collect()), key=str) == brute(rows)


def test_places(spark):
    """A group over many tasks, null groups, equal rows."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, 1, 2, 3]), "x") for _ in range(3000)]
    df = spark.createDataFrame(rows, "g long, o long, note string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = turns.numbered(df, "g", ["o"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.place, r.o if r.o is not None else -1))
    for g, found in by.items():
        assert [p for p, _ in sorted(found)] == list(range(len(found)))
        assert [o for _, o in sorted(found)] == sorted(o for _, o in found), g
    assert len(got) == len(rows) and turns.numbered(df.limit(0), "g", ["o"]).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_conversation_prefixes"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
