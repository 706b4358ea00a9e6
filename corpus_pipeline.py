"""The corpus pipeline: five stages over the documents table, each written and read again before the next one.

language ID -> quality rules -> SimHash near-dedup -> suffix-array dedup -> best-fit packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import near_copies, op1_packing, op2_langid, op3_line_rules, op4_suffix_buckets
from spanforge.llm.common import sort_id, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is unknown or its best language is less likely than this.
LEAST_SCORE = 0.5


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, sort_id("doc_id").alias("_id"), text_hash().alias("_h"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    found = op2_langid.predict(docs, op2_langid.fit(docs))
    return found.where((F.col("lang_pred") != op2_langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines in more than LINE_DOCS texts of a host, whatever its size, go from the others."""
    kept = op3_line_rules.verdicts(docs, line_share=0.0).where("kept").dropDuplicates(["_id", "_h"]).select("_id", "_h", "removed_lines")
    left = op3_line_rules.without_lines(keyed(docs).join(kept, ["_id", "_h"]).select(*COLUMNS, "removed_lines"))
    return left.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more (five-word shingles) the one of smallest id stays."""
    first = near_copies.near_groups(docs).groupBy("group").agg(F.min(F.struct("_id", "_h")).alias("k")).select(F.col("k._id").alias("_id"), F.col("k._h").alias("_h"))
    return keyed(docs).dropDuplicates(["_id", "_h"]).join(first, ["_id", "_h"], "left_semi").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings go; a character of which a part went goes whole.  Rows of one id and equal texts stay as they are."""
    found = op4_suffix_buckets.deduplicated(docs, as_text=True, keep=("lang", "source"))
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing),
]

#: Tokens, fingerprints and a trained model are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
