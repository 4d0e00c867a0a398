"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on what its predecessor kept, which is written as Parquet in the shared folder
and read again, so that a lost executor costs a stage at most.

1. ``toxicity``: documents that the classifier rejects go.
2. ``near_duplicates``: of each SimHash group one row stays, that of the smallest doc_id; one
   without a doc_id only if none of the group has any.
3. ``decontamination``: documents with a benchmark window go.
4. ``secrets``: secrets are replaced by their kind; ``n_chars`` follows where a text changed.
5. ``packing``: documents become token pieces in sequences of 2,048.

SQL can express none of the first two and the last stage, so ``ORACLE_SQL`` is None; the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import decontaminate, packing, secrets, simhash, toxicity
from tollgate.llm.common import settled, table
from tollgate.llm.queries import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, apart=False, in_place=True)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs, length_column="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("secrets", redact),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
