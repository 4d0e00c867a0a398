"""The pipeline: each stage on its predecessor's rows, the first and last held against the operators."""

from pyspark.sql.functions import lit

import corpus_pipeline
from test_simhash import brute_fingerprint, brute_groups
from tollgate.llm import decontaminate, secrets, simhash
from tollgate.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = docs.count()
    assert before >= kept["toxicity"] > kept["near_duplicates"] >= kept["decontamination"] == kept["secrets"] > 0
    assert simhash.near_duplicates(docs).groupBy("component_id").count().where("count > 1").count() <= 3  # redaction may bring texts together
    assert not decontaminate.report(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").count()
    assert secrets.find_secrets(docs).agg({"n_access": "sum"}).first()[0] == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == kept["secrets"]
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_one_row_of_each_group_stays(spark):
    """Rows repeated whole, copies without an id, one id of two texts, against groups by brute force."""
    same, other = "one two three four five six seven", "a wholly different line of text here"
    rows = [(1, same), (2, same), (2, "a clean text that shares its id only"), (2, same), (5, other), (5, other), (5, other),
            (None, same), (None, same), (None, "nameless lines of words"), (None, "nameless lines of words"), (None, "nameless lines of words"),
            (None, None), (9, ""), (10, "apart from all others this stands"), (0, "last in the table but first by id"), (-1, other.upper())]
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(range(len(rows)), fps)
    want = []
    for g in set(groups):
        of = [r for r, x in zip(rows, groups) if x == g]
        want.append(min(of, key=lambda r: (r[0] is None, r[0] or 0)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _row string").repartition(4)
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    beside = simhash.keep_one(df).select("doc_id", "text").collect()  # one row without an id stays beside the named one
    assert len(beside) == len(want) + sum(len({r[0] is None for r, x in zip(rows, groups) if x == g}) == 2 for g in set(groups))


def test_stages_against_brute_force(spark):
    """Near-duplicates on the whole small table, with rows repeated and ids taken away."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id % 5 = 0")
    docs = docs.unionByName(some).unionByName(some.withColumn("doc_id", lit(None).cast("long")))
    rows = docs.select("doc_id", "text").collect()
    groups = brute_groups(range(len(rows)), [brute_fingerprint(r.text) for r in rows])
    want = {}
    for r, g in zip(rows, groups):
        want[g] = min(want.get(g, r), r, key=lambda x: (x.doc_id is None, x.doc_id or 0))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in want.values())
    assert len(set(groups)) == len(got) < len(rows)
