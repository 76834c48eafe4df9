"""The corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage works on all rows its predecessor kept. ``run`` writes every stage's
result as Parquet to the session's shared folder and reads it again; what a stage
wrote on the way to its result is removed then.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.llm import copies, packing, pii, quality, toxicity
from voxledger.session import prepare, settle

# Near copies, fitted models and packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below one half, learned from the labels that are not held out."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    found = toxicity.term_hits(F.col("text"), model.terms)
    return docs.withColumn("__score", toxicity.score(found, model)).filter(F.col("__score") < 0.5).drop("__score")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and whose posterior quality is at least one half."""
    prepare(spark)
    model = quality.fit_quality(docs.select(quality.text_stats("text").alias("stats")), "stats")
    judged = docs.withColumn("__stats", quality.text_stats("text"))
    return judged.filter(quality.judge(F.col("__stats"), model)).drop("__stats")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, found by SimHash and BK-trees and by MinHash bands: the one with the smallest id.

    Links are texts whose five-word shingles are alike by four fifths, checked on whole sets.
    """
    prepare(spark)
    return copies.keep_first(docs, "doc_id", "text")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with personal data masked; ``n_chars`` follows the text."""
    return pii.mask_documents(docs, "text").withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in windows of 1,024 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, "doc_id", "text", str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash", keep_one_of_each),
    ("pii", mask_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(spark, partial(stage, spark, docs, sf_dir), name)
    return docs
