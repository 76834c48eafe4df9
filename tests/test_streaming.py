import datetime as dt
import random

import pytest
from helpers import feedback, minutes_in, plain_scan

from voxledger.catalog.keyword_answers import keyword_answers
from voxledger.session import folders, scratch_path
from voxledger.sources.feedback_table import create_feedback_table
from voxledger.streaming import ingest
from voxledger.streaming.spikes import SpikeStream
from voxledger.streaming.volume import compact_hourly_volume, late_rows, read_hourly_volume, stream_hourly_volume

EPOCH = dt.datetime(1970, 1, 1)


def micros(ts):
    return (ts - EPOCH) // dt.timedelta(microseconds=1)


@pytest.fixture()
def landed(spark, tmp_path):
    """A function that lands a delivery, works it off from the checkpoint and returns the stream."""
    landing, schema = str(tmp_path / "landing"), feedback(spark, []).schema

    def deliver(rows, **how):
        feedback(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        # A new object each time: nothing but the checkpoint and the sink is carried over.
        stream = SpikeStream(str(tmp_path / "windows"), str(tmp_path / "checkpoint"), **how)
        stream.start(spark.readStream.schema(schema).parquet(landing)).awaitTermination()
        return stream

    return deliver


def test_spike_stream_equals_the_scan_over_restarts(spark, landed):
    rng = random.Random(5)
    minutes = sorted(rng.randrange(0, 3000) for _ in range(700))
    deliveries = [[m for m in minutes if lo <= m < lo + 1000] for lo in (0, 1000, 2000)]
    # Rows within the allowed delay may arrive one delivery later; those behind it are counted.
    deliveries[1] += [990, 991, 992, 993, 994]
    deliveries.append([10, 10, 10, 10, 2999])
    for minutes_of in deliveries:
        stream = landed([minutes_in(m) for m in minutes_of], threshold=4, window_minutes=20)
    closed = [r.start_us for r in stream.closed_windows(spark).collect()]
    still_open = [r.start_us for r in stream.open_windows(spark).collect()]
    times = [micros(minutes_in(m)["at"]) for m in minutes + [990, 991, 992, 993, 994, 2999]]
    assert sorted(closed + still_open) == plain_scan(times, 4, 20 * 60_000_000)
    assert closed and still_open and max(closed) < min(still_open)
    assert [tuple(r) for r in stream.late_rows(spark).collect()] == [("Bug", 4)]


def test_categories_bursts_and_block_borders(spark, landed):
    """Exact borders of windows and blocks, many rows in one instant, and rows that raise no tickets."""
    block = 24 * 10
    marks = [0, 10, 20, block - 10, block, block + 10, 2 * block - 1, 2 * block, 3 * block - 5, 3 * block, 3 * block + 5]
    rows = [minutes_in(m, category=c) for m in marks for c in ("Bug", "Complaint", "Praise")]
    rows += [minutes_in(2 * block, category="Bug")] * 50 + [{"at": None}]
    landed(rows[: len(rows) // 2], threshold=2, window_minutes=10, delay_minutes=10_000)
    stream = landed(rows[len(rows) // 2 :] + [minutes_in(30_000, category="Spam"), minutes_in(30_000)], threshold=2, window_minutes=10, delay_minutes=10_000)
    found = stream.closed_windows(spark).unionByName(stream.open_windows(spark)).collect()
    for category in ("Bug", "Complaint"):
        times = [micros(r["at"]) for r in rows + [minutes_in(30_000)] if r["at"] and r.get("category", "Bug") == category]
        assert sorted(r.start_us for r in found if r.category == category) == plain_scan(times, 2, 600_000_000)
    assert {r.category for r in found} == {"Bug", "Complaint"}


def test_empty_deliveries(spark, landed):
    landed([])
    stream = landed([minutes_in(i) for i in range(6)])
    assert stream.closed_windows(spark).count() == 0
    assert stream.open_windows(spark).count() == 1
    assert landed([]).open_windows(spark).count() == 1
    assert stream.late_rows(spark).count() == 0


def test_hourly_volume_counts_late_rows_over_restarts_and_compaction(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / name) for name in ("landing", "out", "checkpoint"))
    schema = feedback(spark, []).schema
    # Minutes after noon: 700 closes the hours before minute 580; 30 is then late, 600 is not.
    deliveries = ([5, 10, 65, 700], [30, 31, 90, 600, 700], [1000, 35, 601])
    for delivered in deliveries:
        feedback(spark, [minutes_in(m) for m in delivered] + [{"at": None}]).coalesce(1).write.mode("append").parquet(landing)
        rows = spark.readStream.schema(schema).parquet(landing)
        stream_hourly_volume(rows, out, checkpoint).awaitTermination()
        compact_hourly_volume(spark, out)
    assert len(folders(spark, out)) == 1
    noon = dt.datetime(2026, 1, 10, 12)
    counts = {(r.hour - noon) // dt.timedelta(hours=1): r["count"] for r in read_hourly_volume(spark, out).collect()}
    late = {(r.hour - noon) // dt.timedelta(hours=1): r.late for r in late_rows(spark, out).collect()}
    assert counts == {0: 2, 1: 1, 10: 2, 11: 2, 16: 1} and late == {0: 3, 1: 1}
    assert sum(counts.values()) + sum(late.values()) == sum(map(len, deliveries))


def test_posts_are_known_over_restarts_and_lose_no_row(spark, tmp_path, monkeypatch):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    entry = "<entry><id>tag/t3_{}</id><title>{}</title><updated>2024-01-0{}T00:00:00+00:00</updated></entry>"
    feed = '<feed xmlns="http://www.w3.org/2005/Atom">{}</feed>'
    feed_type, post_type = "xml string", "id string, title string, selftext string, created_utc double, stickied boolean"
    name = "feedback_" + scratch_path(spark, "t")[-12:]
    create_feedback_table(spark, name, str(tmp_path / "table"))
    handed = []

    def counted(delivery, scorer, table):
        handed.append(delivery.count())
        return upsert(delivery, scorer, table)

    upsert = ingest.upsert_run
    monkeypatch.setattr(ingest, "upsert_run", counted)

    def deliver(entries, posts):
        xml = [(feed.format("".join(entries)),), ("<feed><entry>",), (None,)]
        spark.createDataFrame(xml, feed_type).coalesce(1).write.mode("append").parquet(f"{landing}/feeds")
        spark.createDataFrame(posts, post_type).coalesce(1).write.mode("append").parquet(f"{landing}/posts")
        handed.clear()
        feeds = spark.readStream.schema(feed_type).parquet(f"{landing}/feeds")
        submissions = spark.readStream.schema(post_type).parquet(f"{landing}/posts")
        ingest.stream_posts(feeds, submissions, keyword_answers, name, checkpoint).awaitTermination()
        spark.catalog.refreshTable(name)
        return sum(handed), sorted(str(r.external_id) for r in spark.table(name).collect())

    first = [entry.format("a", "refund failed", 5), entry.format("b", "app crashed", 6)]
    posts = [("p", "late delivery", "body", 1.0, False), ("q", "notice", "", 2.0, True), (None, "no id", "", 3.0, False), (None, "no id", "", 3.0, False)]
    assert deliver(first, posts) == (5, ["None", "None", "reddit_a", "reddit_b", "reddit_p"])
    # Older than all before it, but new; `a` once more as it was, `b` changed.
    again = [first[0], entry.format("b", "app crashed again", 6), entry.format("old", "bad food", 1)]
    assert deliver(again, posts[:1]) == (2, ["None", "None", "reddit_a", "reddit_b", "reddit_old", "reddit_p"])
    assert {r.raw_text for r in spark.table(name).filter("external_id = 'reddit_b'").collect()} == {"app crashed"}
    spark.sql(f"DROP TABLE {name}")
