"""Personal data: base spans against the plain patterns, disclosure against counts by hand."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from tollgate.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
digits = lambda s: re.sub("[^0-9]", "", s)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def brute(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(0)
    parts = ["a", "b@c.d", "@", ".", "x.y", "-", "%", "1", "12", "255", "256", "1.2.3.4", "0001.2", "+", "+1", "(", ")", " ", "4041894974608795",
             "4041-8949-7460-8795", "é", "\n", "_", "a@b", "é@x.y", "٣"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("a" * 50_000 + "@", "1" * 50_000, "1." * 20_000, "0" * 5000 + "1.2.3.4", "+1" + "(" * 50_000, "@a." * 20_000):
        pii.base_spans(t)  # linear time


def corpus():
    """An address that one code name goes with in different surroundings, one in copies, and plain words."""
    rng = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(k, f"{line(6)} Bluebird wrote from jane.roe@lab.example {line(6)}") for k in range(5)]
    rows += [(10 + k, f"copied Redstart text of max@lab.example {'same ' * 3}") for k in range(6)]
    rows += [(30 + k, line(30)) for k in range(60)]
    rows += [(100, "only Bluebird stands here"), (101, None), (102, ""), (None, "bluebird without an id"), (103, "call +49 30 1234567"), (103, "call +49 30 1234567")]
    return rows


def flagged_by_hand(rows):
    texts = [t or "" for _, t in rows]
    n, n_e, n_t, n_te, ways = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        n_t.update(set(re.findall(r"\w+", t.lower())))
        for e, around, terms in pii.surroundings(t, brute(t)):
            n_e[e] += 1
            for w in terms:
                n_te[e, w] += 1
                ways[e, w].add(around)
    out = set()
    for (e, w), k in n_te.items():
        share = math.log2(n * k / (n_t[w] * n_e[e])) / math.log2(n / n_e[e])
        if len(ways[e, w]) >= pii.SUPPORT and share >= pii.DISCLOSES:
            out.add(w)
    return out


def test_spans_of_rows(spark):
    rows = corpus()
    terms = flagged_by_hand(rows)
    assert "bluebird" in terms and "redstart" not in terms and not any(t.startswith("word") for t in terms)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, key int")
    got = sorted(str(tuple(r)) for r in pii.find_personal_data(df).collect())
    want = []
    for d, t in rows:
        base = brute(t or "")
        more = [("term", *m.span()) for m in re.finditer(r"\w+", t or "") if m[0].lower() in terms]
        counts = [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        want.append(str((d, *counts, hashlib.sha256(pii.show(base).encode()).hexdigest(), pii.show(base + more))))
    assert got == sorted(want)


def test_blocks_of_terms(spark, monkeypatch):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    whole = sorted(map(str, pii.find_personal_data(df).collect()))
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert sorted(map(str, pii.find_personal_data(df).collect())) == whole


def test_sanitise(spark):
    df = spark.createDataFrame([(*r, "en") for r in corpus()], "doc_id long, text string, terms string")
    got = pii.sanitise(df)
    assert got.columns == df.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert "jane" not in texts[0] and "Bluebird" not in texts[0] and "Bluebird" not in texts[100] and "[EMAIL]" in texts[0]
    assert texts[101] is None and "Redstart" in texts[10]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(df).collect() == [] and pii.sanitise(df).collect() == []


def test_terms_anywhere_in_the_document(spark):
    """A name far from the address it always goes with, found on words and counts made here, not by the module."""
    rng = random.Random(2)
    line = lambda n: " ".join(f"word{rng.randrange(90)}" for _ in range(n))
    rows = [(k, f"Kestrel {line(20)} {' ' * 700} İzmir{'' if k else ' '} {line(20)} sent by roe@lab.example") for k in range(5)]
    rows += [(10 + k, line(40)) for k in range(60)] + [(100, "Kestrel alone"), (101, "in İzmir")]
    texts, words = [t for _, t in rows], lambda t: {w.lower() for w in re.findall(r"\w+", EMAIL.sub(" ", t))}
    with_e = [t for t in texts if "@" in t]
    want = set()
    for w in set().union(*map(words, with_e)):
        n_te, n_t = sum(w in words(t) for t in with_e), sum(w in words(t) for t in texts)
        if n_te >= 3 and math.log2(len(rows) * n_te / (n_t * 5)) >= 0.8 * math.log2(len(rows) / 5):
            want.add(w)
    assert {"kestrel", "i̇zmir"} <= want and len(want) < 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: re.findall(r"term:(\d+):(\d+)", r.spans) for r in pii.find_personal_data(df).collect()}
    for d, t in rows:
        assert [t[int(a):int(b)].lower() for a, b in got[d]] == [w.lower() for w in re.findall(r"\w+", EMAIL.sub(" ", t)) if w.lower() in want], d


def test_many_terms_are_joined(spark, monkeypatch):
    words = [f"term{k}é" for k in range(300)]
    flagged = spark.createDataFrame([(w, 1.0, "remove") for w in words], "term string, share double, action string")
    df = spark.createDataFrame([(k, f"{w} other{k} {w.upper()}") for k, w in enumerate(words)], "doc_id long, text string")
    whole = sorted(map(str, pii.term_spans(df, flagged).collect()))
    assert len(whole) == 300 and all(str(r).count("a=") == 2 for r in whole)
    monkeypatch.setattr(pii, "BLOCK", 2)
    assert sorted(map(str, pii.term_spans(df, flagged).collect())) == whole
    monkeypatch.setattr(pii, "SIEVE", 64)  # the bitmap lets other words through, the join doesn't
    assert sorted(map(str, pii.term_spans(df, flagged).collect())) == whole
