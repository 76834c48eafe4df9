import datetime as dt
import random

import pytest
from helpers import NOON, feedback, hours_ago, minutes_in, plain_scan
from pyspark.sql import functions as F

from voxledger.operators import spikes, tickets
from voxledger.operators.enrichment import answering
from voxledger.plans import incidents

EPOCH = dt.datetime(1970, 1, 1)


def starts(spark, times_by_category, threshold, window_minutes, partitions=4):
    rows = [
        (i, category, EPOCH + dt.timedelta(microseconds=us))
        for category, times in times_by_category.items()
        for i, us in enumerate(times)
    ]
    df = spark.createDataFrame(rows, "id bigint, category string, created_at timestamp_ntz").repartition(partitions)
    found = {category: [] for category in times_by_category}
    for row in spikes.spike_windows(df, threshold, window_minutes).collect():
        found[row.category].append(row.start_us)
    return {category: sorted(times) for category, times in found.items()}


def check(spark, times_by_category, threshold, window_minutes):
    window = window_minutes * 60_000_000
    want = {c: plain_scan(times, threshold, window) for c, times in times_by_category.items()}
    assert starts(spark, times_by_category, threshold, window_minutes) == want
    return want


def detect(spark, rows, threshold=5, window_minutes=60):
    return incidents.incident_tickets(feedback(spark, rows), threshold, window_minutes).orderBy("number").collect()


@pytest.mark.parametrize(
    "rows",
    [
        [minutes_in(i * 5) for i in range(3)],
        [minutes_in(i * 120) for i in range(6)],
        [minutes_in(i * 2, category=c) for i in range(10) for c in ("Praise", "Spam")],
        [],
    ],
    ids=["too few", "too far apart", "no incident category", "empty"],
)
def test_no_ticket(spark, rows):
    assert detect(spark, rows) == []


def test_one_ticket_with_its_fields(spark):
    rows = [minutes_in(i * 2, text=f"t{i}", source="tweet" if i % 2 else "app_review") for i in range(8)]
    (ticket,) = detect(spark, rows)
    assert (ticket.ticket_id, ticket.category, ticket.affected_count) == ("TIQ-001", "Bug", 8)
    assert ticket.severity == "Critical" and ticket.title == "Critical Priority: Spike in 'Bug' reports"
    assert ticket.source_counts == {"tweet": 4, "app_review": 4} and ticket.sources == ["app_review", "tweet"]
    assert ticket.sample_reviews == ["t0", "t1", "t2"]
    assert [s.source for s in ticket.sample_reviews_with_source] == ["app_review", "tweet", "app_review"]
    assert ticket.window_start == NOON and ticket.window_end == NOON + dt.timedelta(minutes=14)
    # 8 rows in 14 minutes make 34.3 an hour.
    assert ticket.pct_above_baseline == -77


def test_ids_follow_category_then_time(spark):
    rows = [minutes_in(start + i * 2, category=c) for c in ("Complaint", "Bug") for start in (0, 500) for i in range(8)]
    found = detect(spark, rows)
    assert [(t.ticket_id, t.category) for t in found] == [
        ("TIQ-001", "Bug"), ("TIQ-002", "Bug"), ("TIQ-003", "Complaint"), ("TIQ-004", "Complaint"),
    ]
    assert found[0].window_start < found[1].window_start


def test_all_rows_at_one_instant_have_no_baseline(spark):
    (ticket,) = detect(spark, [hours_ago(0, urgency=2)] * 7)
    assert ticket.affected_count == 7 and ticket.pct_above_baseline is None and ticket.severity == "High"


def test_row_at_the_window_end_belongs_to_it(spark):
    minute = 60_000_000
    times = [0, 1, 2, 3, 60 * minute, 60 * minute + 1, 60 * minute + 2, 60 * minute + 3, 120 * minute, 120 * minute + 1]
    assert check(spark, {"Bug": times}, 5, 60)["Bug"] == [0, 60 * minute + 1]


def test_random_times_with_ties(spark):
    rng = random.Random(7)
    minute = 60_000_000
    grid = {
        "Bug": [1_700_000_000_000_000 + rng.randrange(0, 6000) * minute for _ in range(1500)],
        "Complaint": [rng.randrange(-4000, 4000) * minute // 2 for _ in range(900)],
    }
    for threshold, window in ((3, 20), (5, 60), (12, 60)):
        assert check(spark, grid, threshold, window)["Bug"]


def test_dense_bursts_across_blocks_and_spans(spark):
    """One-minute windows over days: several spans, and bursts far denser than a cell."""
    rng = random.Random(11)
    minute = 60_000_000
    sparse = [rng.randrange(0, 3 * 1440 * minute) for _ in range(6000)]
    burst = [2000 * minute + rng.randrange(0, 3 * minute) for _ in range(6000)]
    instant = [2500 * minute + 17] * 500
    even = [3000 * minute + i * 9_999 for i in range(30_000)]
    want = check(spark, {"Bug": sparse + burst + instant, "Complaint": even}, 4, 1)
    assert len(want["Bug"]) > 100 and len(want["Complaint"]) > 4


def test_dense_slots_are_pruned(spark):
    """A corridor keeps a small part of evenly dense times and all real starts."""
    minute = 60_000_000
    times = [i * 5_003 for i in range(60_000)]
    df = spark.createDataFrame([("Bug", t) for t in times], "category string, us bigint")
    reachable = spikes.reachable_times(df, minute)
    kept = {row.us for row in spikes.within(reachable, spikes.corridor(reachable, minute), minute).collect()}
    assert set(plain_scan(times, 1, minute)) <= kept
    assert len(kept) < len(times) / 50


def test_partitioning_does_not_matter(spark):
    rng = random.Random(3)
    times = {"Bug": [rng.randrange(0, 10**11) for _ in range(400)]}
    once = starts(spark, times, 3, 60, partitions=1)
    assert once == starts(spark, times, 3, 60, partitions=16)


def test_threshold_of_one(spark):
    check(spark, {"Bug": [0, 10, 3_600_000_001, 9_000_000_000]}, 1, 60)


def test_members_and_samples(spark):
    rows = [minutes_in(m, source=s) for m in (0, 1, 2, 59, 60, 61, 300, 301, 302, 303, 360) for s in ("a", "b")]
    members = tickets.window_members(feedback(spark, rows), incidents.found_windows(feedback(spark, rows)), 60)
    found = {}
    for row in members.collect():
        found.setdefault(row.start_us, []).append(row.id)
    assert sorted(map(sorted, found.values())) == [list(range(10)), list(range(12, 22))]
    samples = sorted((r.start_us, r.n, r.id) for r in tickets.ticket_samples(members).collect())
    assert [(n, i) for _, n, i in samples] == [(1, 0), (2, 1), (3, 2), (1, 12), (2, 13), (3, 14)]


def test_tickets_are_numbered_by_category_and_time(spark):
    keys = [(c, s * 3_600_000_001) for c in ("Complaint", "Bug") for s in (5, 1, 9, 700)]
    found = spark.createDataFrame(keys, "category string, start_us bigint")
    numbered = tickets.number_tickets(found).orderBy("number").collect()
    assert [(t.category, t.start_us, t.number) for t in numbered] == [(*key, n + 1) for n, key in enumerate(sorted(keys))]


def test_rows_without_a_source_and_repeated_titles(spark):
    rows = [minutes_in(i, source="tweet" if i % 2 else None) for i in range(6)]
    found = incidents.incident_tickets(feedback(spark, rows))
    key = found.first().ticket_key
    titles = spark.createDataFrame([(key, "Second"), (key, "First")], "ticket_key string, title string")
    (card,) = incidents.anomalies(found, titles=titles).collect()
    assert (card.affected_count, [(c.source, c["count"]) for c in card.source_counts]) == (6, [("Twitter", 3)])
    assert card.title == "First"


def test_generated_titles(spark):
    rows = [minutes_in(i, text=f"t{i}") for i in range(6)] + [minutes_in(900 + i) for i in range(6)]
    found = incidents.incident_tickets(feedback(spark, rows))

    def answer(prompts):
        return ['"Login loop"' if "t0" in prompt else "x" * 200 for prompt in prompts]

    titles = incidents.generated_titles(found, answering(answer, key="ticket_key"))
    first, other = incidents.anomalies(found, titles=titles).orderBy("ticket_id").collect()
    assert first.title == "Login loop" and other.title == other.original_title


def test_cards_use_the_stable_key(spark):
    rows = [minutes_in(i, text=f"t{i}", source="tweet") for i in range(6)] + [minutes_in(900 + i) for i in range(6)]
    found = incidents.incident_tickets(feedback(spark, rows))
    second = found.filter("number = 2").select("ticket_key")
    titles = second.selectExpr("ticket_key", "'Login loop' AS title")
    first, other = incidents.anomalies(found, second.unionByName(second), titles).orderBy("ticket_id").collect()
    assert (first.title, first.jira_created) == (first.original_title, False)
    assert (other.title, other.jira_created, other.tracker_key) == ("Login loop", True, "TIQ-JIRA-002")
    assert first.source_counts[0].source == "Twitter" and first.sample_reviews[2].text == "t2"
    assert incidents.anomalies(incidents.incident_tickets(feedback(spark, []))).count() == 0


def test_titles_and_actions_follow_a_window_that_late_rows_move(spark):
    burst = [minutes_in(100 + i) for i in range(6)] + [minutes_in(400 + i) for i in range(6)]
    before = incidents.incident_tickets(feedback(spark, burst))
    titles = before.select("category", "start_us", F.concat(F.lit("Title "), F.col("number").cast("string")).alias("title"))
    stored = spark.createDataFrame([tuple(r) for r in titles.collect()], titles.schema)
    actions = stored.filter("title = 'Title 1'").drop("title")
    # The first window now starts half an hour earlier; another burst of its own comes between the two.
    late = [minutes_in(70)] + [minutes_in(200 + i) for i in range(6)]
    after = incidents.incident_tickets(feedback(spark, burst + late))
    cards = {c.window_start: c for c in incidents.anomalies(after, actions, stored.union(stored)).collect()}
    found = [(cards[at].title, cards[at].jira_created) for at in sorted(cards)]
    assert found == [("Title 1", True), (cards[sorted(cards)[1]].original_title, False), ("Title 2", False)]


def test_records_belong_to_the_window_that_shares_most_time(spark):
    minute = 60_000_000
    now = spark.createDataFrame([("Bug", m * minute) for m in (-100, 0, 61, 500)] + [("Spam", 0)], "category string, start_us bigint")
    records = [("Bug", 31, "b"), ("Bug", 40, "c"), ("Bug", 0, "a"), ("Bug", 0, "z"), ("Bug", 440, "none"), ("Bug", -160, "edge"), ("Spam", 59, "s"), (None, 0, "n"), ("Bug", None, "n")]
    rows = spark.createDataFrame([(c, None if m is None else m * minute, t) for c, m, t in records], "category string, start_us bigint, title string")
    found = {(r.category, r.start_us // minute): r.title for r in tickets.recorded(now, rows, 60, "title").collect()}
    assert found == {("Bug", 0): "a", ("Bug", 61): "c", ("Spam", 0): "s"}
    assert tickets.recorded(now, rows.limit(0), 60, "title").count() == 0
    assert tickets.recorded(now, rows, 60).count() == 3
