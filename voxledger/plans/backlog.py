"""The ranked backlog: filtered pages and the full export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import display as D
from voxledger.operators.filters import filter_facets, filter_recent, search_text
from voxledger.operators.ordering import page_totals, paginate
from voxledger.operators.priority import score
from voxledger.sources.feedback_table import write_csv


def matching_feedback(
    df: DataFrame,
    category: str | None = None,
    sentiment: str | None = None,
    source: str | None = None,
    search: str | None = None,
    hours: int | None = None,
    mode: str = "regex",
) -> DataFrame:
    """Rows that pass the filters; the time anchor is the newest row of the full table. Here 0 hours are no limit."""
    return search_text(filter_facets(filter_recent(df, hours or None), category, sentiment, source), search, mode)


def select_display(df: DataFrame) -> DataFrame:
    return df.select(*S.EXPORT_COLUMNS)


def backlog(df: DataFrame, page: int = 1, limit: int = 25, **filters) -> DataFrame:
    """One page of the backlog with the totals of the whole match on every row.

    A page past the end is one row with the totals and no item. Filters run before
    scoring, volumes still come from the full table.
    """
    matching = matching_feedback(df, **filters)
    # A page holds at most 200 rows, so joining them to the one row of totals is small.
    rows = paginate(score(matching, full=df), page, limit)
    return page_totals(matching, limit).join(rows, F.lit(True), "left").select(
        "id",
        "priority_score",
        "category",
        "sentiment",
        "urgency_score",
        D.source_label(F.col("source"), "backlog").alias("source"),
        F.col("source").alias("raw_source"),
        "clean_text",
        D.minute_text(F.col("created_at")).alias("created_at"),
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        "total",
        "total_pages",
    )


def backlog_export(df: DataFrame, **filters) -> DataFrame:
    """All matching rows, highest priority first, in the export columns."""
    scored = score(matching_feedback(df, **filters), full=df)
    return select_display(scored.orderBy(F.desc_nulls_last("priority_score"), "id"))


def export_backlog_csv(df: DataFrame, path: str, single_file: bool = False, **filters) -> None:
    """Write the export; an empty table has nothing to export."""
    if df.isEmpty():
        raise LookupError("no feedback to export")
    write_csv(backlog_export(df, **filters), path, single_file)
