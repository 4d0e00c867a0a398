"""Decontamination against brute force, and the SQL against both."""

import hashlib
import random
import re

import pytest

from tollgate.llm import decontaminate


def words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, window=10):
    wins = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        wins += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    if item is not None:
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def rows():
    rng = random.Random(2)
    vocab = ["the", "of", "Über", "ñandú", "x1", "kappa", "Rho", "42", "日本", "é"] + [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, line(rng.randint(10, 25))) for k in range(12)]
    items += [(100, "kappa rho"), (101, "42"), (102, ""), (103, None), (None, line(11)), (104, items[0][1]), (10, "the of the")]
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "42"), (None, "42 kappa-Rho"), (5, "same 42"), (5, "same 42"), (5, "other text of this id")]
    for d in range(20, 60):
        parts = [line(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            text = rng.choice([t for _, t in items if t])
            w = text.split()
            a = rng.randint(0, len(w) - 1)
            parts += [rng.choice([text.upper(), " ".join(w[a : a + 12]), ", ".join(w)]), line(rng.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    docs.append((70, (items[1][1] + " ") * 300))
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, n_words int, item_id string")
    i = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    return d, i


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_against_brute_force(spark, block):
    docs, items = rows()
    got = decontaminate.report(*frames(spark, docs, items), block=block).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(docs, items)))


def test_empty_tables(spark):
    docs, items = rows()
    d, i = frames(spark, docs, items)
    assert decontaminate.report(d.limit(0), i).collect() == []
    got = decontaminate.report(d, i.limit(0)).collect()
    assert len(got) == len(docs) and not any(r.contaminated for r in got)


def test_clean_keeps_rows_and_columns(spark):
    docs, items = rows()
    d, i = frames(spark, docs, items)
    kept = decontaminate.clean(d, i)
    assert kept.columns == d.columns
    want = [(doc, t) for (doc, t), b in zip(docs, brute(docs, items)) if not b[-1]]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))


def test_no_python_in_the_plan(spark):
    docs, items = rows()
    plan = decontaminate.report(*frames(spark, docs, items))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
