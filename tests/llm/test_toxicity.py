"""Toxicity: gradients, held-out accuracy, whole texts, edge cases."""

import numpy as np
import pytest

from tollgate.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters().items()}
    words = 9
    gf, gb = rng.normal(size=(words, 3 * toxicity.HIDDEN)), rng.normal(size=(words, 3 * toxicity.HIDDEN))
    idx = rng.integers(0, words, (3, 6))
    length = np.array([6, 4, 1])
    logit, state = toxicity.forward(p, gf.astype(np.float32), gb.astype(np.float32), idx, length, keep=True)
    w = rng.normal(size=3)
    g, dgf, dgb = toxicity.backward(p, state, w, idx, words)

    def value():
        return float(toxicity.forward(p, gf.astype(np.float32), gb.astype(np.float32), idx, length)[0] @ w)

    for name, grad in [("Uf", g["Uf"]), ("Ub", g["Ub"]), ("A", g["A"]), ("v", g["v"]), ("o", g["o"])]:
        at = tuple(rng.integers(0, n) for n in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-2
        up = value()
        p[name][at] = old - 1e-2
        down = value()
        p[name][at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3, name
    for gates, grad in ((gf, dgf), (gb, dgb)):
        at = (int(idx[0, 2]), 5)
        old = gates[at]
        gates[at] = old + 1e-2
        up = value()
        gates[at] = old - 1e-2
        down = value()
        gates[at] = old
        assert abs((up - down) / 2e-2 - grad[at]) < 2e-3


def test_windows_cover_everything():
    for n in (0, 1, 63, 64, 65, 112, 113, 500, 255, 256, 257, 2000):
        spans = toxicity.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b - a <= toxicity.WINDOW for a, b in spans)
        assert all(x[1] > y[0] for x, y in zip(spans, spans[1:]))


def test_held_out_accuracy_and_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs, model)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    toxic = [r for r in rows if r.toxic == 1]
    assert right >= 0.97 * len(rows) and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == found.where("predicted = 0").count() < docs.count()

    odd = [(1, None), (2, ""), (3, "!!! 12 ..."), (None, "no id"), (4, "word " * 20_000), (4, "word " * 20_000), (5, "clown " + "fine " * 9000)]
    df = spark.createDataFrame([(*r, 3.0, True) for r in odd], "doc_id long, text string, score double, held_out boolean")
    got = toxicity.score_documents(df, model).collect()
    assert [r.doc_id for r in got] == [d for d, _ in odd] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score < 0.5 and got[4].score == got[5].score and not got[3].held_out
    assert toxicity.score_documents(df.limit(0), model).collect() == []


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score < 1e-6 for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()] == [True, True]


@pytest.mark.parametrize("words", [["a"], ["ab"], ["abc"], ["abcd"], ["abcde"], ["abcdef", "a"], ["\u00e9"]])
def test_few_bytes(words):
    """The new words of a batch may have fewer bytes in all than an n-gram."""
    buckets, ends = toxicity.word_buckets(words)
    assert len(ends) == len(words) and ends[-1] == len(buckets) >= len(words)
    one = toxicity.Scorer(toxicity.new_parameters(3))
    assert np.isfinite(one.scores([" ".join(words), words[-1]])).all()


def test_a_repeated_id_gives_one_text(spark):
    rows = [(1, "b text", 1), (1, "a text", 1), (2, "fine words", 0), (3, "more fine words", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    models = [toxicity.fit(df.repartition(n).drop("toxic"), df.select("doc_id", "toxic")) for n in (1, 4)]
    assert all(np.array_equal(models[0][k], models[1][k]) for k in models[0])


def test_batches_do_not_change_scores(monkeypatch):
    p = toxicity.new_parameters(3)
    texts = ["one two three", "", "four " * 300, "five six", "seven " * 70]
    whole = toxicity.Scorer(p).scores(texts)
    monkeypatch.setattr(toxicity, "GROUP", 2)
    monkeypatch.setattr(toxicity, "MEMO", 1)
    one = toxicity.Scorer(p)
    assert np.allclose(whole, [one.scores([t])[0] for t in texts], atol=1e-5)
