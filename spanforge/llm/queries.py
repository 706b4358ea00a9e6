"""The registered queries of the operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_packing, op2_langid, op3_line_rules, op4_suffix_buckets, op5_warc, op6_reply_trees, op7_fm_index, op8_telephony, op9_simhash, op10_trie_bpe, op11_minhash, op12_vector_codes, op13_divergence
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_langid.identified(table(spark, sf_dir, "documents"))


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_line_rules.verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *op3_line_rules.FIGURES, "base_failed", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_suffix_buckets.digests(op4_suffix_buckets.deduplicated(table(spark, sf_dir, "documents")))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_warc.archived(table(spark, sf_dir, "pages"))


def op6_reply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, says = F.col("id").alias("turn"), F.lit("</s>[INST] ok [/INST]").alias("text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.union(probe)
    return op6_reply_trees.digests(op6_reply_trees.formatted(op6_reply_trees.thread_messages(rows)))


def op7_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_fm_index.digests(op7_fm_index.deduplicated(table(spark, sf_dir, "documents")))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_telephony.stored_features(table(spark, sf_dir, "documents"))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op10_trie_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return op10_trie_bpe.digests(op10_trie_bpe.encode_texts(table(spark, sf_dir, "documents"), vocabulary))


def op11_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_minhash.minhash_groups(table(spark, sf_dir, "documents"))


def op12_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_best_fit_packing, op2_language_id, op3_line_frequency, op4_suffix_dedup, op5_warc_index, op6_reply_paths, op7_fm_dedup, op8_telephony_audio, op9_simhash_groups, op10_trie_encoding,
    op11_minhash_groups, op12_partial_distance_codes, op13_source_divergence,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_frequency": op3_line_rules.ORACLE_SQL,
        "op6_reply_paths": op6_reply_trees.ORACLE_SQL,
        "op11_minhash_groups": op11_minhash.ORACLE_SQL,
        "op12_partial_distance_codes": op12_vector_codes.ORACLE_SQL,
        "op13_source_divergence": op13_divergence.ORACLE_SQL,
    }
