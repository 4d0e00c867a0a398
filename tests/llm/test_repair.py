"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
import xxhash

from tollgate.llm import repair
from tollgate.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)
GOOD = re.compile("(s?(ua)+)?")


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def in_order(row):
    _, turn, role, text = row
    a = signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42)))
    return (turn is not None, turn or 0, a)


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(c, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) by dynamic programming from the end; rows are (initial, fault)."""
    states = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            c, x = best(i, states[state], inserts + 1)
            found.append((c + 2, "I" + x))
        if i < len(rows):
            initial, fault = rows[i]
            steps = [("D", state, 3)]
            if fault not in "bd":
                late = fault == "t"
                if initial == states[state] or (state == "" and initial == "s"):
                    steps.append(("K", initial, late))
                steps.append(("R", states[state], 2 + late))
            for e, to, cost in steps:
                c, x = best(i + 1, to, 0)
                found.append((c + cost, e + x))
        return min(found) if found else (10**9, "")

    return best(0, "", 0)


def brute(rows, ids=None):
    """Rows as they are (after damage) -> the report."""
    by = {c: [] for c in (ids if ids is not None else {r[0] for r in rows})}
    for r in rows:
        by[r[0]].append(r)
    out = []
    for c, of in by.items():
        of = sorted(of, key=in_order)
        turns = {t for _, t, _, _ in of if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in of:
            bare = text.strip(WHITE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        initials = [r[2][:1] for r in of]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = cheapest(tuple(zip(initials, faults)))
        state, rest, lines = "", iter(of), []
        for e in audit:
            if e == "I":
                state = "a" if state == "u" else "u"
                lines.append(("user" if state == "u" else "assistant") + ":")
                continue
            _, _, role, text = next(rest)
            if e == "D":
                continue
            state = role[0] if e == "K" else "a" if state == "u" else "u"
            lines.append((role if e == "K" else "user" if state == "u" else "assistant") + ":" + text)
        assert GOOD.fullmatch("".join(x[0] for x in lines))
        out.append((c, gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage", "User"]
TEXTS = ["One.", "Two!", "Three? ", "no end", "", " \t", None, "é", "a.\n", "b "]


def random_rows(seed, n, longest=9, null_ids=True):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = None if null_ids and c == 3 else c
        for t in range(rng.randint(0, longest)):
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.6 else f"Text {rng.random()}."))
    return rows


def filled(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = repair.report(df)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(filled(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_search_against_all_edits(n):
    """Short conversations: the audit is the least of all edit strings that a regular expression accepts."""
    rng = random.Random(n)
    for _ in range(40):
        rows = [(rng.choice("suao"), rng.choice("..tbd")) for _ in range(n)]
        best = None
        for length in range(n, n + 5):
            for e in itertools.product("DIKR", repeat=length):
                if sum(x != "I" for x in e) != n:
                    continue
                at, state, text, cost, fine = iter(rows), "", "", 0, True
                for x in e:
                    after = "a" if state == "u" else "u"
                    if x == "I":
                        state, cost = after, cost + 2
                        text += state
                        continue
                    initial, fault = next(at)
                    if x == "D":
                        cost += 3
                        continue
                    fine = fine and fault not in "bd"
                    cost += (fault == "t") + 2 * (x == "R")
                    state = initial if x == "K" else after
                    text += state
                if fine and GOOD.fullmatch(text):
                    best = min(best or (cost, "".join(e)), (cost, "".join(e)))
            if n > 3 and length == n + 2:
                break
        found = repair.search(rows, repair.EMPTY, repair.END)
        assert found == best or (n > 3 and found[0] <= best[0]), rows


def test_lower_bounds_never_exceed_costs():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(rng.choice("suao"), rng.choice("...tbd")) for _ in range(rng.randint(0, 12))]
        assert repair.lower_bounds(rows)[0] <= cheapest(tuple(rows))[0]
        assert repair.search(rows, repair.EMPTY, repair.END) == cheapest(tuple(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = random_rows(seed, 60)
    check(spark, rows + rows[:5])


def test_conversations_of_many_blocks(spark, monkeypatch):
    """One conversation holds most rows; blocks of four rows make the ways between blocks matter."""
    rng = random.Random(5)
    rows = [(7, t if t % 50 else None, rng.choice(ROLES), rng.choice(TEXTS) if rng.random() < 0.2 else f"Text {t}.") for t in range(400)]
    rows += random_rows(6, 25, longest=14)
    monkeypatch.setattr(repair.blocks, "__defaults__", (2,))
    monkeypatch.setattr(repair.chosen_edits, "__defaults__", (2,))
    check(spark, rows)


def test_blocks_of_the_given_size(spark):
    rng = random.Random(8)
    check(spark, [(1, t, rng.choice(["user", "assistant"]), f"Text {t}.") for t in range(200)] + [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(129)])


def test_damage_and_conversations_that_vanish(spark):
    rows = [(c, t, r, x) for c, t, r, x in random_rows(3, 200, longest=4)] + [(c, 0, "user", "Only.") for c in range(500, 560)]
    df = spark.createDataFrame(rows, SCHEMA)
    after = repair.damage(df)
    assert sorted(map(str, (tuple(r) for r in after.collect()))) == sorted(map(str, damaged(rows)))
    got = sorted((tuple(r) for r in repair.report(after, df).collect()), key=str)
    want = brute(damaged(rows), {r[0] for r in rows})
    assert got == want and any(r[-2] == "" for r in want)


def test_repaired_turns(spark):
    rows = random_rows(4, 40)
    turns = repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in turns:
        by.setdefault(r.conv_id, []).append((r.turn, f"{r.role}:{r.text}"))
    for c, *_, digest in brute(filled(rows)):
        found = sorted(by.get(c, []))
        assert [t for t, _ in found] == list(range(len(found)))
        assert hashlib.sha256("\n".join(x for _, x in found).encode()).hexdigest() == digest


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.report(empty).collect() == [] and repair.repair(empty).collect() == [] and repair.damage(empty).collect() == []
    rows = [(1, 0, "user", "long " * 60_000), (1, 1, "assistant", "x" * 200_000 + "."), (1, 2, "user", "x." * 3), (2, None, None, None),
            (3, -(2**63), "user", "far."), (3, 2**63 - 1, "assistant", "away.")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", cost int, a string")
    got = {r.conv_id: r for r in repair.report(df).collect()}
    want = {r[0]: r for r in brute(filled(rows))}
    assert tuple(got[1]) == want[1] and tuple(got[2]) == want[2]
    assert got[3].audit == want[3][-2] and got[3].gaps == 0  # a width beyond a long has no count


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(damaged(rows), {r[0] for r in rows})
