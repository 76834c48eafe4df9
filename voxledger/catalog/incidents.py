"""Spike windows, tickets and what hangs off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.registry import query
from voxledger.operators import enrichment, spikes, tickets
from voxledger.plans import incidents
from voxledger.sources.driver_tables import feedback, feedback_text

WINDOWS = f"WITH RECURSIVE {Q.CTE_FB}, {Q.CTE_WINDOWS} "
TICKETS = f"WITH RECURSIVE {Q.CTE_FB}, {Q.CTE_TICKETS} "
TEXT_TICKETS = f"WITH RECURSIVE {Q.CTE_FBT}, {Q.CTE_TICKETS} "

SAMPLES = """, ranked AS (SELECT m.category, m.start_us, m.id, m.source, fbt.clean_text,
      row_number() OVER (PARTITION BY m.category, m.start_us ORDER BY m.created_at, m.id) AS n
    FROM members m JOIN fbt ON fbt.id = m.id),
  samples AS (SELECT * FROM ranked WHERE n <= 3)"""


def _members(spark, sf_dir, rows=None):
    rows = feedback(spark, sf_dir) if rows is None else rows
    return tickets.window_members(rows, incidents.found_windows(rows), 60)


def _tickets(spark, sf_dir):
    rows = feedback(spark, sf_dir)
    windows = incidents.found_windows(rows)
    members = tickets.window_members(rows, windows, 60)
    return tickets.number_tickets(tickets.spike_tickets(rows, members))


@query("spike_windows", WINDOWS + "SELECT category, start_us, make_timestamp(start_us) AS window_start FROM chain")
def _(spark, sf_dir):
    return spikes.spike_windows(feedback(spark, sf_dir))


@query(
    "sort_by_time",
    WINDOWS + "SELECT category, us, count(*) AS n FROM inc GROUP BY category, us",
)
def _(spark, sf_dir):
    return spikes.incident_times(feedback(spark, sf_dir)).orderBy("category", "us")


@query(
    "spike_tickets",
    TICKETS + """SELECT category, start_us, affected_count, avg_urgency, window_start, window_end, severity, title,
      60 AS window_minutes, pct_above_baseline FROM titled""",
)
def _(spark, sf_dir):
    found = tickets.spike_tickets(feedback(spark, sf_dir), _members(spark, sf_dir))
    return found.drop("source_counts", "sources")


@query(
    "ticket_sources",
    TICKETS + "SELECT category, start_us, source, count(*) AS count FROM members GROUP BY category, start_us, source",
)
def _(spark, sf_dir):
    return tickets.ticket_sources(_members(spark, sf_dir)).select("category", "start_us", "source", "count")


@query("ticket_samples", TEXT_TICKETS + SAMPLES + " SELECT category, start_us, n::INT AS n, id, source, clean_text FROM samples")
def _(spark, sf_dir):
    return tickets.ticket_samples(_members(spark, sf_dir, feedback_text(spark, sf_dir)))


@query("ticket_numbering", TICKETS + "SELECT category, start_us, number, ticket_id, ticket_key FROM titled")
def _(spark, sf_dir):
    windows = incidents.found_windows(feedback(spark, sf_dir))
    return tickets.number_tickets(windows.select("category", "start_us"))


@query("ticket_action_flag", TICKETS + "SELECT ticket_id, ticket_key, number % 3 = 0 AS jira_created FROM titled")
def _(spark, sf_dir):
    found = _tickets(spark, sf_dir)
    recorded = found.filter(F.col("number") % 3 == 0).select("category", "start_us")
    flagged = tickets.with_action_flag(found, recorded.unionByName(recorded))
    return flagged.select("ticket_id", "ticket_key", "jira_created")


@query(
    "ticket_title_lookup",
    TICKETS + """SELECT ticket_id, CASE WHEN number % 2 = 0 THEN 'Stored ' || ticket_id ELSE title END AS title,
      title AS original_title FROM titled""",
)
def _(spark, sf_dir):
    found = _tickets(spark, sf_dir)
    stored = found.filter(F.col("number") % 2 == 0).select(
        "category", "start_us", F.concat(F.lit("Stored "), F.col("ticket_id")).alias("title")
    )
    return tickets.with_stored_title(found, stored).select("ticket_id", "title", "original_title")


@query(
    "title_prompts",
    TEXT_TICKETS + SAMPLES + """ SELECT ticket_key, string_agg('- ' || clean_text, chr(10) ORDER BY n) AS samples
      FROM samples JOIN titled USING (category, start_us) GROUP BY ticket_key""",
)
def _(spark, sf_dir):
    found = incidents.incident_tickets(feedback_text(spark, sf_dir))
    return enrichment.build_title_prompts(found).select("ticket_key", "samples")


@query(
    "anomalies",
    TEXT_TICKETS + SAMPLES + f""",
    src AS (SELECT category, start_us, string_agg({Q.label('source')} || ':' || n, ';' ORDER BY source) AS source_counts
            FROM (SELECT category, start_us, source, count(*) AS n FROM members GROUP BY 1, 2, 3) GROUP BY 1, 2),
    smp AS (SELECT category, start_us, string_agg({Q.label('source')} || ':' || clean_text, ';' ORDER BY n) AS sample_reviews
            FROM samples GROUP BY 1, 2)
    SELECT ticket_id, ticket_key, replace(ticket_id, 'TIQ-', 'TIQ-JIRA-') AS tracker_key,
      CASE WHEN number % 2 = 0 THEN 'Stored ' || ticket_id ELSE title END AS title, title AS original_title,
      severity, category, affected_count, 60 AS window_minutes, pct_above_baseline, source_counts, sample_reviews,
      number % 3 = 0 AS jira_created, window_start, window_end, avg_urgency
    FROM titled JOIN src USING (category, start_us) JOIN smp USING (category, start_us)""",
)
def _(spark, sf_dir):
    found = incidents.incident_tickets(feedback_text(spark, sf_dir))
    actions = found.filter(F.col("number") % 3 == 0).select("category", "start_us")
    titles = found.filter(F.col("number") % 2 == 0).select(
        "category", "start_us", F.concat(F.lit("Stored "), F.col("ticket_id")).alias("title")
    )
    cards = incidents.anomalies(found, actions, titles)
    pairs = F.transform("source_counts", lambda s: F.concat_ws(":", s["source"], s["count"].cast("string")))
    quotes = F.transform("sample_reviews", lambda s: F.concat_ws(":", s["source"], s["text"]))
    return cards.withColumn("source_counts", F.array_join(pairs, ";")).withColumn(
        "sample_reviews", F.array_join(quotes, ";")
    )
