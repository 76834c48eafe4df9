"""Row filters of the backlog and the incident detector."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import text as X
from voxledger.functions.numeric import hours_before_newest


def filter_recent(df: DataFrame, hours: int | None, ts: str = "created_at") -> DataFrame:
    """Rows within ``hours`` of the newest row, both ends included: 0 keeps the newest instant, None all rows."""
    if hours is None:
        return df
    return df.filter(F.col(ts) >= hours_before_newest(df, hours, ts))


def filter_facets(
    df: DataFrame,
    category: str | None = None,
    sentiment: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Equality per facet; an empty value means the facet is not filtered."""
    for column, value in (("category", category), ("sentiment", sentiment), ("source", source)):
        if value:
            df = df.filter(F.col(column) == value)
    return df


def filter_multiselect(
    df: DataFrame,
    categories: Sequence[str] = (),
    sentiments: Sequence[str] = (),
    sources: Sequence[str] = (),
) -> DataFrame:
    """Membership per facet; an empty list means the facet is not filtered."""
    for column, values in (("category", categories), ("sentiment", sentiments), ("source", sources)):
        if values:
            df = df.filter(F.col(column).isin(*values))
    return df


def search_text(df: DataFrame, term: str | None, mode: str = "regex", column: str = "clean_text") -> DataFrame:
    """Case-insensitive search. The term is a pattern unless ``mode`` is ``literal``."""
    if not term:
        return df
    text = F.lower(F.col(column))
    if mode == "literal":
        return df.filter(text.contains(term.lower()))
    if mode != "regex":
        raise ValueError(f"unknown search mode: {mode}")
    try:
        re.compile(term.lower())
    except re.error as error:
        raise ValueError(f"bad search pattern: {error}") from error
    return df.filter(text.rlike(term.lower()))


def filter_incident_categories(df: DataFrame) -> DataFrame:
    return df.filter(F.col("category").isin(*S.INCIDENT_CATEGORIES))


def drop_noise(df: DataFrame, min_words: int = 3, max_mentions: int = 5) -> DataFrame:
    """Drop texts too short to label, mention trains, and link-only texts."""
    return df.filter(
        (F.col("clean_text") != "")
        & (X.mentions(F.col("raw_text")) <= max_mentions)
        & X.has_words(F.col("clean_text"), min_words)
    )


def keep_original_posts(df: DataFrame, lang: str = "en") -> DataFrame:
    """Posts in one language that are neither reposts nor promoted."""
    return df.filter((F.col("lang") == lang) & ~F.col("is_repost") & ~F.col("is_promoted"))
