"""Removal of repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from tollgate.llm import substrings

SF = "/root/testdata/sf0.001"


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, h string, runs string")
    got = sorted(tuple(map(str, r)) for r in substrings.report(df, length, **options).collect())
    assert got == sorted(tuple(map(str, (r[0], *b))) for r, b in zip(rows, brute([r[1] for r in rows], length)))


def sample():
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(2, 7))).decode() for _ in range(300)] + ["é", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(12) for _ in range(4)]
    rows = [(1, None), (2, ""), (3, "short"), (4, "ab" * 400), (5, "a" * 700), (6, "a" * 700), (None, text(20)), (None, text(20))]
    for d in range(10, 60):
        parts = [text(rng.randint(1, 40)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), rng.choice(shared))
        rows.append((d, " ".join(parts)))
    for d in range(60, 75):  # near copies
        near = list(rows[20][1])
        near[rng.randrange(len(near))] = "Z"
        rows.append((d, "".join(near)))
    rows += [rows[12], rows[12], (12, "another text of the same id " + shared[0])]
    return [(*r, 1, "x", "y") for r in rows]


@pytest.mark.parametrize("crowd", [1, 4096])
def test_against_brute_force(spark, crowd):
    check(spark, sample(), 40, gram=12, crowd=crowd)


def test_texts_without_an_id_whose_short_hashes_agree(spark):
    shared, alone = "the passage that stands in two of the rows, word for word. ", "nothing of this line is found again in any other place! "
    rows = [(d, t, 1, "x", "y") for d in (None, 4) for t in (shared + "9758", alone + "198644", shared + "39777", alone + "17614")][:6]
    rows = [r for r in rows if r[0] is None or r[1].startswith(shared)]
    df = spark.createDataFrame([(r[1],) for r in rows if r[0] is None], "text string")
    assert df.selectExpr("hash(text, isnull(text)) AS h").distinct().count() == 2  # four texts
    check(spark, rows, 40, gram=12)


def test_long_texts_are_scanned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rng = random.Random(5)
    base = "".join(rng.choice("abcd") for _ in range(3000))
    texts = [base, "x" + base[500:1500] + "y" + base[:300], "".join(rng.choice("abcd") for _ in range(2000)) + base[2000:]]
    data = [t.encode() for t in texts]
    found = []
    for chunk, ends, row, begin in substrings.chunks(data, 40):
        text, s1, s2, h, ctx = substrings.anchors(chunk, ends, 40, 12)
        starts = ends - [len(chunk[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        for t, a, b in zip(text, s1, s2):
            found += [(int(row[t]), int(begin[t] + x - starts[t])) for x in range(a, b + 1)]
    assert sorted(found) == [(r, x) for r, t in enumerate(data) for x in range(len(t) - 39)]


def test_equal_strings_meet_at_equal_anchors():
    import numpy as np

    rng = random.Random(1)
    text = bytes(rng.choice(b"abc") for _ in range(3000))
    moved = bytes(rng.choice(b"abc") for _ in range(77)) + text[1000:2000]
    of = []
    for t in (text, moved):
        _, s1, s2, h, _ = substrings.anchors(np.frombuffer(t, np.uint8), np.array([len(t)]), 60, 20)
        of.append({s: int(x) for a, b, x in zip(s1, s2, h) for s in range(a, b + 1)})
    assert all(of[0][1000 + i] == of[1][77 + i] for i in range(1000 - 60 + 1))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in substrings.report(docs).collect())
    assert got == sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 200)))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.report(df).collect() == []
    assert substrings.remove_repeats(df).collect() == []


def test_remove_repeats_keeps_columns(spark):
    df = spark.createDataFrame([(1, "q" * 300 + "kept", "en"), (2, None, "de")], "doc_id long, text string, runs string")
    got = substrings.remove_repeats(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "kept", 2: None}
