"""SentencePiece encoding and decoding against the library: ids, spans, decoded text."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tollgate.llm import pieces
from tollgate.llm.queries import QUERIES, vocabulary

PATH = vocabulary("piece_bpe_32k.model")
RAW = open(PATH, "rb").read()
ODD = ["", " ", "  ", "Two  blanks", "\n\n a", "héé<s>x</s><unk>", "▁a ▁ b", "ｆｕｌｌ", "a\x00b", "​ a", "<0x41>", "﻿x", "é",
       "  at both ends  ", "\t\tx\r\ny", "日本語 テスト", "x" * 500, "ab" * 400 + " " * 37, "① ﬁ  　 x　", "🙂🙂 é \U0001f9d1‍🦰",
       "a" * 40 + " " + "b" * 41, "▁" * 90]
LETTERS = " abcdeéñ▁  \n\t.,!①ﬁ日本🙂　ｆA0123456789<>́​\xa0"


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 70))) for _ in range(n)]


def same_as_library(raw, some):
    library, mine = sentencepiece.SentencePieceProcessor(model_proto=raw), pieces.Encoder(raw)
    for t in some:
        want = library.encode(t, return_type="proto").pieces
        ids, starts, ends = mine.encode(t)
        assert ids == [p.id for p in want], t
        assert list(zip(starts.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], t
        assert mine.decode(ids) == library.decode(ids), t


def test_random_texts():
    same_as_library(RAW, ODD + random_texts(1500, 1))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze,dummy,byte_fallback", [(False, True, True), (True, True, True), (True, False, False), (False, True, False)])
def test_compiled_maps(rule, squeeze, dummy, byte_fallback):
    """The same vocabulary under compiled character maps that rewrite, join and drop characters."""
    of_rule = sentencepiece_model_pb2.ModelProto()
    of_rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(RAW)
    spec = model.normalizer_spec
    spec.precompiled_charsmap = of_rule.normalizer_spec.precompiled_charsmap
    spec.remove_extra_whitespaces, spec.add_dummy_prefix = squeeze, dummy
    model.trainer_spec.byte_fallback = byte_fallback
    if not byte_fallback:
        kept = [p for p in model.pieces if p.type != pieces.BYTE]
        del model.pieces[:]
        model.pieces.extend(kept)
    same_as_library(model.SerializeToString(), ODD + random_texts(300, 2))


def test_decoding_any_ids():
    library, mine, rng = sentencepiece.SentencePieceProcessor(model_proto=RAW), pieces.Encoder(RAW), random.Random(3)
    for _ in range(1500):
        ids = [rng.choice([0, 1, 2, 3, 198, 200, 230, 243, 259, 28705, 13, 300, 5000]) for _ in range(rng.randint(0, 9))]
        assert mine.decode(ids) == library.decode(ids), ids


def test_bytes_that_are_no_text():
    assert pieces.decode_bytes(b"a\xff\xc3\xa9\xe2\x82") == "a�é��"


def test_merging_many_parts_is_merging_each():
    one = pieces.Encoder(RAW)
    some = [p for t in random_texts(400, 4) for p in one.part.findall(one.normalise(t).text)]
    some = sorted({p for p in some if all(one.char_id[ord(c)] >= 0 for c in p)} | {"▁" * k for k in range(1, 40)})
    for part, (ids, sizes) in zip(some, one.merge_many(some)):
        assert ids == [one.ids[p] for p in one.merge(part)], part
        assert np.frombuffer(sizes, np.int32).tolist() == [len(p.encode()) for p in one.merge(part)]
    assert one.merge_many([]) == []


def test_a_small_memory_changes_nothing(monkeypatch):
    some = random_texts(200, 5) + ODD
    want = pieces.Encoder(RAW).digests(some)
    monkeypatch.setattr(pieces, "MEMO", 7)
    monkeypatch.setattr(pieces, "GROUP", 50)
    assert pieces.Encoder(RAW).digests(some) == want == [pieces.Encoder(RAW).digests([t])[0] for t in some]


def test_other_models_are_refused():
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(RAW)
    model.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        pieces.Encoder(model.SerializeToString())


def test_rows(spark):
    odd = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "long " * 60_000), (5, "x" * 100_000), (6, "日本 🙂")]
    df = spark.createDataFrame([(*r, 7, "ids") for r in odd], "doc_id long, text string, n_tokens int, ids string")
    library = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    got = pieces.piece_digests(df, PATH).collect()
    assert [r.doc_id for r in got] == [d for d, _ in odd]
    for r, (_, t) in zip(got, odd):
        p = library.encode(t or "", return_type="proto").pieces
        ids = [x.id for x in p]
        assert (r.n_tokens, r.n_bytes) == (len(ids), len((t or "").encode()))
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()
        assert r.ends_crc32 == zlib.crc32(np.array([x.end for x in p], "<i8").tobytes())
    rows = pieces.encode_documents(df, PATH)
    for r, (_, t) in zip(rows.collect(), odd):
        raw = (t or "").encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends)) == raw  # the spans cover the text
    assert [r.text for r in pieces.decode_documents(rows, PATH).collect()] == [t or "" for _, t in odd]
    assert pieces.piece_digests(df.limit(0), PATH).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=RAW)
    got = QUERIES["op13_sentencepiece"](spark, sf).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(library.decode(ids).encode()).hexdigest()
