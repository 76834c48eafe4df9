"""Incident tickets built from spike windows.

``windows`` is the (materialized) output of ``spike_windows``. Windows of one
category never overlap, so a row belongs to at most one ticket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import display as D
from voxledger.functions.numeric import half_even, micros
from voxledger.operators.filters import filter_incident_categories
from voxledger.operators.metrics import baseline_rate
from voxledger.operators.ordering import with_position
from voxledger.operators.spikes import time_slot, window_micros

KEY = ["category", "start_us"]
SAMPLES = 3
SHUFFLE_CELLS = 60


def window_members(df: DataFrame, windows: DataFrame, window_minutes: int) -> DataFrame:
    """Incident rows with the ``start_us`` of the window they fall into.

    The range condition becomes an equality on slots of a sixtieth of the window,
    which spreads a burst where rows and windows meet in a shuffle; Spark decides
    by the windows' size whether they do.
    """
    window_us = window_micros(window_minutes)
    slot_us = max(1, window_us // SHUFFLE_CELLS)
    first, last = (time_slot(us, slot_us) for us in (F.col("start_us"), F.col("start_us") + window_us))
    slots = windows.select(*KEY, F.explode(F.sequence(first, last)).alias("_slot"))
    rows = filter_incident_categories(df).withColumn("_us", micros(F.col("created_at")))
    rows = rows.withColumn("_slot", time_slot(F.col("_us"), slot_us))
    inside = (F.col("_us") >= F.col("start_us")) & (F.col("_us") <= F.col("start_us") + window_us)
    joined = rows.join(slots, ["category", "_slot"])
    return joined.filter(inside).drop("_us", "_slot")


def ticket_sources(members: DataFrame) -> DataFrame:
    """Rows, urgency and time range per ticket and source, in long form."""
    return members.groupBy(*KEY, "source").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("urgency_score").alias("urgency_sum"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def ticket_samples(members: DataFrame) -> DataFrame:
    """The first rows of each ticket by time; ``n`` counts from 1.

    Each task keeps at most three rows per ticket, so no more texts than that are
    shuffled, whatever the size of the burst.
    """
    by_time = Window.partitionBy(*KEY).orderBy("created_at", "id")
    rows = members.select(*KEY, "created_at", "id", "source", "clean_text")
    numbered = rows.withColumn("n", F.row_number().over(by_time)).filter(F.col("n") <= SAMPLES)
    return numbered.select(*KEY, "n", "id", "source", "clean_text")


def number_tickets(tickets: DataFrame) -> DataFrame:
    """Sequential ids over categories ascending, then time, beside the stable key."""
    numbered = with_position(tickets, "start_us", [F.asc("category")], "number").withColumn("number", F.col("number") + 1)
    return numbered.withColumn("ticket_id", D.ticket_id(F.col("number"))).withColumn(
        "ticket_key", D.ticket_key(F.col("category"), F.col("start_us"))
    )


def spike_tickets(
    df: DataFrame, members: DataFrame, window_minutes: int = S.SPIKE_WINDOW_MINUTES
) -> DataFrame:
    """One row per window with its size, severity, time range and excess over the usual rate."""
    baselines = baseline_rate(df, window_minutes).agg(
        F.map_from_entries(F.collect_list(F.struct("category", "baseline"))).alias("by_category")
    )
    baseline = F.try_element_at(baselines.scalar(), F.col("category"))
    excess = (F.col("affected_count") - baseline) / F.nullif(baseline, F.lit(0.0)) * 100
    return (
        ticket_sources(members)
        .groupBy(*KEY)
        .agg(
            F.sum("count").alias("affected_count"),
            half_even(F.sum("urgency_sum") / F.sum("count"), 1).alias("avg_urgency"),
            F.min("first_at").alias("window_start"),
            F.max("last_at").alias("window_end"),
            # Rows without a source count towards the ticket but name no channel.
            F.map_from_entries(
                F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "count"))))
            ).alias("source_counts"),
        )
        .withColumn("severity", D.severity(F.col("avg_urgency")))
        .withColumn("title", D.ticket_title(F.col("severity"), F.col("category")))
        .withColumn("window_minutes", F.lit(window_minutes))
        .withColumn("pct_above_baseline", F.rint(excess).cast("bigint"))
        .withColumn("sources", F.array_sort(F.map_keys("source_counts")))
    )


def with_samples(tickets: DataFrame, members: DataFrame) -> DataFrame:
    """Attach up to three sample texts per ticket, alone and with their source."""
    gathered = (
        ticket_samples(members)
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_list(F.struct("n", "source", "clean_text"))).alias("s"))
        .select(
            *KEY,
            F.col("s.clean_text").alias("sample_reviews"),
            F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["clean_text"].alias("clean_text"))).alias(
                "sample_reviews_with_source"
            ),
        )
    )
    return tickets.join(gathered, KEY, "left")


def recorded(tickets: DataFrame, records: DataFrame, window_minutes: int, *values: str) -> DataFrame:
    """What was stored for windows, beside the tickets that these windows are now: ``KEY`` and the values.

    ``records`` name a window by category and start, as it was when they were
    stored; rows that arrived since may have moved it. A record belongs to the
    ticket of its category whose window shares most time with it (of two, the
    earlier), and to none where no window shares any. A ticket shows its nearest
    record; of equally near ones the least by value. Repeats do not matter, records
    without category or start belong to no ticket.

    Records that hold a ``ticket_key`` in place of a start belong to the ticket that
    has this key now.

    Windows that share time start in the same slot of one window's length or in
    adjacent ones, so both meet in an equality join on category and slot.
    """
    if "start_us" not in records.columns:
        records = records.select("ticket_key", *values).join(tickets.select("ticket_key", *KEY), "ticket_key")
    window_us = window_micros(window_minutes)
    named = records.select("category", F.col("start_us").alias("_at"), F.struct(F.lit(1), *values).alias("_values"))
    known = named.groupBy("category", "_at").agg(F.min("_values").alias("_values"))
    slot = time_slot(F.col("_at"), window_us)
    known = known.select("*", F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    now = tickets.select(*KEY, time_slot(F.col("start_us"), window_us).alias("_slot"))
    near = known.join(now, ["category", "_slot"]).withColumn("_gap", F.abs(F.col("start_us") - F.col("_at")))
    near = near.filter(F.col("_gap") < F.lit(window_us))
    owner = F.min(F.struct("_gap", "start_us", "_values")).alias("_own")
    owned = near.groupBy("category", "_at").agg(owner).select("category", "_own.*")
    nearest = F.min(F.struct("_gap", "_values")).alias("_nearest")
    return owned.groupBy(*KEY).agg(nearest).select(*KEY, *(F.col("_nearest._values")[v].alias(v) for v in values))


def with_action_flag(tickets: DataFrame, actions: DataFrame, window_minutes: int = S.SPIKE_WINDOW_MINUTES) -> DataFrame:
    """``jira_created`` is true when an action (``category``, ``start_us``) was recorded for the ticket's window."""
    done = recorded(tickets, actions, window_minutes).withColumn("_done", F.lit(True))
    joined = tickets.join(done, KEY, "left")
    return joined.withColumn("jira_created", F.coalesce("_done", F.lit(False))).drop("_done")


def with_stored_title(tickets: DataFrame, titles: DataFrame, window_minutes: int = S.SPIKE_WINDOW_MINUTES) -> DataFrame:
    """Show the title (``category``, ``start_us``, ``title``) stored for the ticket's window, else its generic one."""
    named = titles.filter("title IS NOT NULL").withColumnRenamed("title", "_stored")
    joined = tickets.withColumnRenamed("title", "original_title").join(recorded(tickets, named, window_minutes, "_stored"), KEY, "left")
    return joined.withColumn("title", F.coalesce("_stored", "original_title")).drop("_stored")
