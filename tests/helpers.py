"""Small frames in the shapes the operators expect."""

from __future__ import annotations

import datetime as dt

NOON = dt.datetime(2026, 1, 10, 12, 0, 0)
FEEDBACK_TYPE = (
    "id bigint, source string, clean_text string, created_at timestamp_ntz, "
    "category string, sentiment string, urgency_score int"
)


def feedback(spark, rows):
    """Rows as dicts; what a test does not care about gets a default."""
    filled = [
        (
            row.get("id", i),
            row.get("source", "app_review"),
            row.get("text", "checkout failed"),
            row.get("at", NOON),
            row.get("category", "Bug"),
            row.get("sentiment", "Negative"),
            row.get("urgency", 3),
        )
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(filled, FEEDBACK_TYPE)


def hours_ago(hours, **rest):
    return {"at": NOON - dt.timedelta(hours=hours), **rest}


def minutes_in(minutes, **rest):
    return {"at": NOON + dt.timedelta(minutes=minutes), "urgency": 4, **rest}


def plain_scan(times, threshold, window):
    """The rule of the spike detector, one row after the other."""
    times, starts, i = sorted(times), [], 0
    while i < len(times):
        j = i
        while j < len(times) and times[j] <= times[i] + window:
            j += 1
        if j - i >= threshold:
            starts.append(times[i])
            i = j
        else:
            i += 1
    return starts
