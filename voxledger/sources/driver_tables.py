"""Feedback-shaped views over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.text import clean_text
from voxledger.session import materialize_buckets

SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_feedback(events: DataFrame) -> DataFrame:
    """Events as labelled feedback rows."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind, user = F.col("event_type"), F.col("user_id") % 4
    return events.select(
        F.col("event_id").alias("id"),
        F.when(user == 0, "app_review")
        .when(user == 1, "play_store")
        .when(user == 2, "tweet")
        .otherwise("support_ticket")
        .alias("source"),
        F.col("ts").alias("created_at"),
        F.when(kind == "error", "Bug")
        .when(kind == "click", "Complaint")
        .when(kind == "signup", "Feature Request")
        .when(kind == "view", "Praise")
        .otherwise("Spam")
        .alias("category"),
        F.when(k % 3 == 0, "Neutral")
        .when(kind.isin("error", "click"), "Negative")
        .when(kind == "view", "Positive")
        .otherwise("Neutral")
        .alias("sentiment"),
        (F.lit(1) + k % 5).alias("urgency_score"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_feedback(table(spark, sf_dir, "events"))


def cleaned_documents(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").alias("raw_text"), clean_text(F.col("text")).alias("clean_text"))


def feedback_text(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Feedback rows, or the given ones made of them, with text. As in the feedback table, cleaned text is stored, not recomputed.

    Texts are stored by their key, so however often the result is used they are shuffled once.
    """
    documents = materialize_buckets(cleaned_documents(table(spark, sf_dir, "documents")), "doc_id", "cleaned", S.TEXTS)
    rows = feedback(spark, sf_dir) if rows is None else rows
    rows = rows.withColumn("doc_id", F.col("id") % documents.agg(F.count(F.lit(1))).scalar())
    return rows.join(documents, "doc_id").drop("doc_id")
