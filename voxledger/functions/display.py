"""Display values: labels, severities, titles, formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxledger.functions.text import strip

# Channel names shown to people.
SOURCE_LABELS = {
    "app_review": "App Store",
    "play_store": "Play Store",
    "tweet": "Twitter",
    "support_ticket": "Support Ticket",
}
CHART_LABELS = {**SOURCE_LABELS, "tweet": "Twitter / X"}

TICKET_PREFIX = "TIQ-"
TRACKER_PREFIX = "TIQ-JIRA-"


def source_label(source: Column, style: str = "ticket") -> Column:
    """Channel name. ``chart`` and ``ticket`` title-case unknown channels, ``backlog`` keeps them."""
    labels = CHART_LABELS if style == "chart" else SOURCE_LABELS
    table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    unknown = source if style == "backlog" else F.initcap(F.replace(source, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(table, source), unknown)


def severity(avg_urgency: Column) -> Column:
    return F.when(avg_urgency >= 4, "Critical").otherwise("High")


def ticket_title(level: Column, category: Column) -> Column:
    return F.concat(level, F.lit(" Priority: Spike in '"), category, F.lit("' reports"))


def ticket_id(number: Column, prefix: str = TICKET_PREFIX) -> Column:
    return F.format_string(prefix + "%03d", number)


def tracker_key(ticket: Column, prefix: str = TICKET_PREFIX) -> Column:
    return F.concat(F.lit(TRACKER_PREFIX), F.replace(ticket, F.lit(prefix), F.lit("")))


def ticket_key(category: Column, start_micros: Column) -> Column:
    """Identity that survives renumbering."""
    return F.sha2(F.concat_ws("|", category, start_micros.cast("string")), 256)


def accept_title(answer: Column, fallback: Column) -> Column:
    """Use a generated title when it is non-empty and short, else the generic one."""
    title = strip(F.btrim(strip(answer), F.lit('"')))
    return F.when((title != "") & (F.length(title) < 100), title).otherwise(fallback)


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def delta_text(pct: Column) -> Column:
    """Signed percentage; stays null when there is no baseline."""
    return F.concat(F.when(pct >= 0, "+").otherwise(""), pct.cast("string"), F.lit("%"))
