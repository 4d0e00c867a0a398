"""The registered queries of this subpackage: each applies one operator to its whole table.

``ORACLE`` has DuckDB SQL where SQL can express the result; the other operators are held
against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm import decontaminate, nearest, packing, pieces, pii, prefixes, repair, repair_sql, secrets, sharding, simhash, substrings, tokens, toxicity
from tollgate.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op5_token_counts")
def op5_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


@register("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048, 0)


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@register("op10_benchmark_decontamination", decontaminate.ORACLE)
def op10_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op1_information_theoretic_pii")
def op1_information_theoretic_pii(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@register("op2_vector_bin_sharding")
def op2_vector_bin_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@register("op9_pruned_graph_neighbours")
def op9_pruned_graph_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


@register("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@register("op6_repeated_strings")
def op6_repeated_strings(spark, sf_dir):
    return substrings.report(table(spark, sf_dir, "documents"))


@register("op13_sentencepiece")
def op13_sentencepiece(spark, sf_dir):
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register("op11_conversation_prefixes", prefixes.ORACLE)
def op11_conversation_prefixes(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@register("op12_conversation_repair", repair_sql.oracle())
def op12_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damage(rows), rows)
