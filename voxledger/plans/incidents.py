"""Incident tickets over the full table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import display as D
from voxledger.operators import tickets as K
from voxledger.operators.enrichment import Scorer, build_title_prompts
from voxledger.operators.spikes import spike_windows
from voxledger.session import materialize


def found_windows(df: DataFrame, threshold: int = S.SPIKE_THRESHOLD, window_minutes: int = S.SPIKE_WINDOW_MINUTES) -> DataFrame:
    """Detected windows, written once so that tickets can use them several times."""
    return materialize(spike_windows(df, threshold, window_minutes), "windows")


def incident_tickets(
    df: DataFrame, threshold: int = S.SPIKE_THRESHOLD, window_minutes: int = S.SPIKE_WINDOW_MINUTES
) -> DataFrame:
    """Numbered tickets with sources and samples. ``df`` carries ``id`` and ``clean_text``."""
    windows = found_windows(df, threshold, window_minutes)
    members = K.window_members(df, windows, window_minutes)
    return K.with_samples(K.number_tickets(K.spike_tickets(df, members, window_minutes)), members)


def generated_titles(tickets: DataFrame, scorer: Scorer) -> DataFrame:
    """Titles for tickets that have samples, ``ticket_key``, ``title`` and what places them, to be stored.

    An answer that is empty, too long or missing leaves the generic title.
    """
    answers = scorer(build_title_prompts(tickets)).select("ticket_key", "response")
    joined = tickets.select("ticket_key", *K.KEY, F.col("title").alias("_generic")).join(answers, "ticket_key")
    return joined.select("ticket_key", *K.KEY, D.accept_title(F.col("response"), F.col("_generic")).alias("title"))


def anomalies(
    tickets: DataFrame,
    actions: DataFrame | None = None,
    titles: DataFrame | None = None,
    window_minutes: int = S.SPIKE_WINDOW_MINUTES,
) -> DataFrame:
    """Ticket cards: stored title, recorded action, channel names.

    Titles and actions are stored by category and start of a window and follow it
    where rows that arrive late move its start.
    """
    spark = tickets.sparkSession
    if actions is None:
        actions = spark.createDataFrame([], "category string, start_us bigint")
    if titles is None:
        titles = spark.createDataFrame([], "category string, start_us bigint, title string")
    cards = K.with_action_flag(K.with_stored_title(tickets, titles, window_minutes), actions, window_minutes)
    sources = F.transform(
        F.map_entries("source_counts"),
        lambda e: F.struct(D.source_label(e["key"]).alias("source"), e["value"].alias("count")),
    )
    samples = F.transform(
        "sample_reviews_with_source",
        lambda s: F.struct(D.source_label(s["source"]).alias("source"), s["clean_text"].alias("text")),
    )
    return cards.select(
        "ticket_id",
        "ticket_key",
        D.tracker_key(F.col("ticket_id")).alias("tracker_key"),
        "title",
        "original_title",
        "severity",
        "category",
        "affected_count",
        "window_minutes",
        "pct_above_baseline",
        sources.alias("source_counts"),
        samples.alias("sample_reviews"),
        "jira_created",
        "window_start",
        "window_end",
        "avg_urgency",
    )
