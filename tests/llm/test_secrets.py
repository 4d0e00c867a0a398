"""Secret scans against plain regular expressions; trigram queries."""

import hashlib
import random
import re
import time

import pyarrow as pa
import pytest

from tollgate.llm import secrets

PARTS = ["password", "PassWord", "passwd", "api", "_", "key", "APIKEY", " ", "  ", ":", "=", '"', "'", "AKIA", "AKIA" + "Z9" * 9, "x", "é",
         "abcdef0123456789abcdef0123", "tokeN", "secret=é", "hunter22", "ſecret", "abc", "\n", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]


def brute(text):
    out = []
    for k, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_scan_equals_plain_matching():
    rng = random.Random(0)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + [None, "", "password=" * 3000 + "abcdefg"]
    s = secrets.Scanner()
    assert s.scan(pa.array(texts, pa.string())) == [brute(t) for t in texts]
    part = pa.array(["x", *texts], pa.string()).slice(1, 200)  # a slice has an offset
    assert s.scan(part) == [brute(t) for t in texts[:200]]


def test_pieces_of_the_index(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 7)
    texts = ["xx password=abcdef", "pass", "word=abcdefgh", "AKIA" + "A" * 16, "é token: 123456"]
    assert secrets.Scanner().scan(pa.array(texts)) == [brute(t) for t in texts]


def test_queries():
    q = secrets.trigram_query
    assert q("AKIA[A-Z0-9]+") == ("and", frozenset({b"aki", b"kia"}))
    assert q("[0-9a-f]+") is True and q("a?b") is True and q("(abc)?") is True
    assert q("abc|xyz") == ("or", frozenset({b"abc", b"xyz"}))
    assert q("(?:abc)+d") in (b"abc", ("and", frozenset({b"abc"})))
    assert q("ab?c") is True  # "ac" has no trigram
    assert q("xa[bc]y") == ("or", frozenset({("and", frozenset({b"xab", b"aby"})), ("and", frozenset({b"xac", b"acy"}))}))


def test_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef1"), (3, "AKIA" + "Q" * 16), (3, "AKIA" + "Q" * 16), (4, "API_KEY: 'zzzzzz' " + "f" * 30)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = sorted(map(str, (tuple(r) for r in secrets.find_secrets(df).collect())))
    want = []
    for d, t in rows:
        found = brute(t)
        named = [(secrets.RULES[k], a, b) for a, k, b in found]
        show = lambda x: ",".join(f"{r.kind}:{a}:{b}" for r, a, b in x)
        counts = [sum(r.kind == k for r, _, _ in named) for k in secrets.BASE_KINDS]
        want.append((d, *counts, hashlib.sha256(show([x for x in named if x[0].base]).encode()).hexdigest(), show(named)))
    assert got == sorted(map(str, want))
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_redaction_keeps_all_else(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b", 21, "x"), (2, "clean", 5, None), (3, None, None, "y")], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in secrets.redact_secrets(df, length_column="n_chars").collect()}
    assert got[1].text == "a [ASSIGN] b" and got[1].n_chars == len("a [ASSIGN] b")
    assert tuple(got[2]) == (2, "clean", 5, None) and tuple(got[3]) == (3, None, None, "y")


def test_web_tokens_are_the_matches_of_their_rule():
    rule = next(r for r in secrets.RULES if r.kind == "jwt")
    regex, rng = re.compile(rule.pattern, re.ASCII), random.Random(4)
    parts = ["eyJ", "eyJabcdefgh", ".", ".eyJ", "-", "_", "abcdefgh12", " ", "é", "x", "eyJ-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(60_000)]
    texts += ["eyJabcdefgh.eyJabcdefgh.s", "xeyJabcdefgh.eyJabcdefgh.s", "abc.eyJabcdefgh.eyJabcdefgh.eyJabcdefgh.s", "eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + ".c."]
    for t in texts:
        assert secrets.web_tokens(t) == [m.span() for m in regex.finditer(t)], t
    assert sum(bool(secrets.web_tokens(t)) for t in texts) > 100


@pytest.mark.parametrize("text", ["eyJ-" * 500_000, "eyJabcdefgh." * 150_000, ".eyJ" * 500_000, "eyJ" + "a" * 2_000_000, ".eyJabcdefgh" * 150_000 + "-" * 10])
def test_hostile_texts_take_linear_time(text):
    started = time.monotonic()
    secrets.Scanner().scan(pa.array([text]))
    assert time.monotonic() - started < 20
