"""A training-corpus pipeline: quality rules, near-duplicates, repeated passages, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of ``docs``, whatever they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberframe.llm import near, packing, passages, rules
from emberframe.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the learned decision list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The list is learned from a table of statistics alone; texts are not written for it, their statistics are counted again.
    stats = cut_lineage(rules.text_statistics(docs), "statistics")
    learned = rules.learn_decision_list(stats.where(~rules.base_failed()), labels)
    nested = rules.text_statistics(docs.select("text", F.struct(*docs.columns).alias("row")), keep=("row",))
    # The row number keeps the conditions from being pushed below the statistics, where each would count them anew.
    nested = nested.withColumn("_place", F.monotonically_increasing_id())
    return nested.where((F.col("_place") >= 0) & ~rules.base_failed() & ~learned.rejects()).select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without those that have a near-duplicate of a smaller id; rows without id stay."""
    later = near.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of 50 words and more that a smaller id has too; ``n_chars`` follows the text."""
    cut = passages.remove_passages(docs, passages.repeated_passages(docs))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts, in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("minhash_near_dedup", minhash_near_dedup), ("substring_dedup", substring_dedup),
    ("pack_sequences", pack_sequences),
]

#: The learned list and the online packing have no SQL form; tests hold each operator against brute force and the stages' columns and rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
