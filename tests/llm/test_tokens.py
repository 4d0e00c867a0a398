"""Token counts equal the library's for every prefix."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tollgate.llm import tokens
from tollgate.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = [" ", "  ", "\n", " ", "\t", "'re", "'s", "'ll", "'", "foo", "Bar", "é", "日本", "😀", "12", "3", "!!", "=", "a", " ", "\x1c", "́", "ªß"]


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(PATH)


def test_every_prefix(counter):
    rng = random.Random(1)
    for _ in range(150):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        want = [lib(t[:x]) for x in range(len(t) + 1)]
        assert counter.prefix_counts(t).tolist() == want, t
        for budget in (0, 1, 4):
            assert counter.cut(t, budget) == next((x - 1 for x in range(len(t) + 1) if want[x] > budget), len(t))


def test_special_strings(counter):
    for t in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endof", "  <|endoftext|>\n\n"):
        assert counter.count(t) == lib(t)
        assert counter.prefix_counts(t).tolist() == [lib(t[:x]) for x in range(len(t) + 1)]


def test_bounded_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 5)
    monkeypatch.setattr(tokens, "GROUP", 20)
    c = tokens.PrefixCounter(PATH)
    batch = ["one two three, four", "one two", "", "x" * 5000, "three two one; " * 20]
    assert c.counts(batch) == [lib(t) for t in batch]


def test_whole_table_and_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (4, "word " * 3000), (5, "=" * 9000)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows += [tuple(r) for r in docs.collect()]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, n_tokens int, cut string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, PATH).collect())
    want = [(str(d), len((t or "").encode()), lib(t or ""), lib(t or "") > 1024) for d, t in rows]
    assert got == sorted(want)
    assert tokens.count_tokens(df.limit(0), PATH).collect() == []


def test_pair_rule_agrees_with_merging(counter):
    """The neighbours rule against encoding both tokens together."""
    rng = random.Random(4)
    vocab = sorted(counter.vocab)
    for _ in range(300):
        a, b = rng.choice(vocab), rng.choice(vocab)
        raw = [{v: k for k, v in tokens.ALPHABET.items()}.get(ord(c), ord(c)) for c in a + b]
        try:
            text = bytes(raw).decode()
        except UnicodeDecodeError:
            continue
        pieces = [p for p, _ in counter.pre.pre_tokenize_str(text)]
        if pieces == [a + b] and LIB.encode(text, add_special_tokens=False).tokens:
            assert counter.may_follow(a, b) == (LIB.encode(text, add_special_tokens=False).tokens == [a, b])


def test_counts_are_integers(counter):
    assert counter.prefix_counts("abc").dtype == np.int64
