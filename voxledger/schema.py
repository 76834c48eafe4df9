"""Table shapes and the fixed vocabulary every operator shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Label vocabulary and fallbacks.
CATEGORIES = ("Bug", "Feature Request", "Complaint", "Spam", "Praise")
SENTIMENTS = ("Negative", "Neutral", "Positive")
FALLBACK_CATEGORY = "Uncategorized"
FALLBACK_SENTIMENT = "Neutral"
FALLBACK_URGENCY = 1
MIN_URGENCY, MAX_URGENCY = 1, 5

# How much each category counts towards priority.
CATEGORY_WEIGHTS = {
    "Bug": 1.5,
    "Complaint": 1.2,
    "Feature Request": 0.8,
    "Praise": 0.2,
    "Spam": 0.0,
    "Uncategorized": 0.5,
}
OTHER_CATEGORY_WEIGHT = 0.5

# Only these categories can raise an incident.
INCIDENT_CATEGORIES = ("Bug", "Complaint")
SPIKE_THRESHOLD = 5
SPIKE_WINDOW_MINUTES = 60

# A text and its cleaned form, alike in most rows.
TEXTS = ("raw_text", "clean_text")

# Model batching and channel defaults.
BATCH_SIZE = 15
BATCH_TEXT_CHARS = 1000
SINGLE_TEXT_CHARS = 2000
DEFAULT_CHANNELS = ("swiggy",)

# Columns of the backlog export, in order.
EXPORT_COLUMNS = (
    "priority_score",
    "category",
    "sentiment",
    "urgency_score",
    "source",
    "clean_text",
    "created_at",
)

RAW_CONTRACT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("created_at", T.StringType()),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("clean_text", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("category", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("urgency_score", T.IntegerType()),
        T.StructField("priority_score", T.DoubleType()),
    ]
)

LABELS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("urgency_score", T.IntegerType()),
    ]
)
