"""Answers to batch prompts from keywords, so that ingest queries need no model: the first group found decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = (
    (("crash", "errand", "freez"), ("Bug", "Negative", 5)),
    (("late ", "tionti", "bad"), ("Complaint", "Negative", 4)),
    (("add ", "wish", "mentqu"), ("Feature Request", "Neutral", 2)),
    (("love", "great", "heit"), ("Praise", "Positive", 1)),
)


def _label(text: Column) -> Column:
    def json(category: str, sentiment: str, urgency: int) -> Column:
        return F.lit(f'{{"category": "{category}", "sentiment": "{sentiment}", "urgency_score": {urgency}}}')

    found = F.lit(None).cast("string")
    for words, label in reversed(KEYWORDS):
        found = F.when(text.rlike("|".join(words)), json(*label)).otherwise(found)
    return F.coalesce(found, json("Spam", "Neutral", 1))


def keyword_answers(prompts: DataFrame) -> DataFrame:
    """A scorer over the items of batch prompts."""
    texts = F.transform(F.split("items", "\n"), lambda line: F.lower(F.regexp_replace(line, r'^[0-9]+\. "', "")))
    labels = F.array_join(F.transform(texts, _label), ", ")
    return prompts.select("chunk", "batch_id", F.concat(F.lit("```json\n["), labels, F.lit("]\n```")).alias("response"))
