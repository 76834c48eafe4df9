import datetime as dt

import pytest
from helpers import NOON, feedback, hours_ago

from voxledger.operators import filters, metrics
from voxledger.plans import dashboard


def kpis(df, hours=24):
    return {row.metric: row for row in metrics.kpis(df, hours).collect()}


def test_kpis_of_nothing(spark):
    found = kpis(feedback(spark, []))
    assert [found[name].value for name in metrics.KPI_NAMES] == [0, 0, 0, 0]
    assert all(row.delta_pct is None for row in found.values())


def test_kpis_show_increase(spark):
    found = kpis(feedback(spark, [hours_ago(1), hours_ago(2), hours_ago(30)]))
    assert found["total_feedback"].value == 2 and found["total_feedback"].delta_pct == 100.0


def test_no_previous_rows_means_no_delta(spark):
    assert kpis(feedback(spark, [hours_ago(1), hours_ago(2)]))["total_feedback"].delta_pct is None


def test_kpis_look_at_the_current_window_only(spark):
    rows = [hours_ago(1, urgency=5), hours_ago(2, category="Praise", urgency=1), hours_ago(40, urgency=5)]
    found = kpis(feedback(spark, rows))
    assert found["bugs_reported"].value == 1 and found["avg_urgency"].value == 3.0


def test_averages_round_half_to_even(spark):
    rows = [hours_ago(0, urgency=2)] * 3 + [hours_ago(0, urgency=3)]
    assert kpis(feedback(spark, rows))["avg_urgency"].value == 2.2


def test_window_start_belongs_to_the_current_window(spark):
    found = metrics.split_windows(feedback(spark, [hours_ago(0), hours_ago(24), hours_ago(48), hours_ago(48.1)]), 24)
    assert [row.period for row in found.orderBy("id").collect()] == ["current", "current", "previous"]


def test_hourly_volume(spark):
    assert metrics.hourly_volume(feedback(spark, [])).collect() == []
    found = metrics.hourly_volume(feedback(spark, [hours_ago(1), hours_ago(1.1), hours_ago(5)]), 24)
    assert found.columns == ["hour", "count"]
    counts = [row["count"] for row in found.orderBy("hour").collect()]
    assert counts == [1, 0, 0, 1, 1] and sum(counts) == 3


def test_peak_needs_three_rows_and_half_more_than_usual(spark):
    quiet = metrics.hourly_volume(feedback(spark, [hours_ago(9), hours_ago(0), hours_ago(0)]), 24)
    assert metrics.peak_annotation(quiet).count() == 0
    assert metrics.peak_annotation(quiet, min_peak=0).count() == 1
    loud = metrics.hourly_volume(feedback(spark, [hours_ago(5)] * 4 + [hours_ago(3)] * 4 + [hours_ago(0)]), 24)
    peak = metrics.peak_annotation(loud).collect()
    assert [(row.peak_time, row.peak_count, row.pct_above_baseline) for row in peak] == [("07:00", 4, 167)]
    assert peak[0].label == "Spike Detected: ~07:00 (+167% above norm)"


def test_sentiments_in_fixed_order_with_zeros(spark):
    rows = [hours_ago(1), hours_ago(2), hours_ago(2, sentiment="Odd")]
    found = metrics.sentiment_share(metrics.sentiment_distribution(feedback(spark, rows))).orderBy("ord").collect()
    assert [(r.sentiment, r["count"], r.percentage) for r in found] == [
        ("Negative", 2, 100.0), ("Neutral", 0, 0.0), ("Positive", 0, 0.0),
    ]
    empty = metrics.sentiment_share(metrics.sentiment_distribution(feedback(spark, []))).collect()
    assert [(r["count"], r.percentage) for r in empty] == [(0, 0.0)] * 3


def test_sources_most_first(spark):
    rows = [hours_ago(1, source="tweet")] * 3 + [hours_ago(1)] + [hours_ago(1, source="play_store")]
    found = metrics.share_of_max(metrics.source_breakdown(feedback(spark, rows))).collect()
    by_source = {r.source: (r["count"], round(r.share_pct, 3)) for r in found}
    assert by_source == {"tweet": (3, 100.0), "app_review": (1, 33.333), "play_store": (1, 33.333)}
    assert [r.source for r in metrics.source_breakdown(feedback(spark, rows)).collect()] == ["tweet", "app_review", "play_store"]
    assert metrics.source_breakdown(feedback(spark, [])).count() == 0


def test_everything_else_survives_empty_input(spark):
    nothing = feedback(spark, [])
    assert metrics.facet_values(nothing).count() == 0
    assert metrics.baseline_rate(nothing).count() == 0
    assert dashboard.volume_peak(nothing).count() == 0
    assert dashboard.source_chart(nothing).count() == 0
    assert dashboard.metadata(nothing).filter("kind = 'total_records'").first().value == 0
    assert dashboard.charts(nothing).count() == 3


def test_filters(spark):
    rows = [
        hours_ago(0, text="Payment FAILED twice", source="tweet"),
        hours_ago(24, text="a.b", category="Praise", sentiment="Positive"),
        hours_ago(24.5, text="axb"),
    ]
    df = feedback(spark, rows)

    def ids(found):
        return [row.id for row in found.orderBy("id").collect()]

    assert ids(filters.filter_recent(df, 24)) == [0, 1]
    assert ids(filters.filter_recent(df, None)) == [0, 1, 2]
    assert ids(filters.filter_recent(df, 0)) == [0]
    assert ids(filters.filter_facets(df, category="", source="tweet")) == [0]
    assert ids(filters.filter_multiselect(df, ["Bug", "Praise"], [], ["app_review"])) == [1, 2]
    assert ids(filters.search_text(df, "failed|A.B")) == [0, 1, 2]
    assert ids(filters.search_text(df, "A.B", mode="literal")) == [1]
    assert ids(filters.search_text(df, None)) == [0, 1, 2]
    with pytest.raises(ValueError):
        filters.search_text(df, "(")


def test_recent_filter_reaches_the_scan(spark, tmp_path):
    feedback(spark, [hours_ago(i) for i in range(30)]).write.parquet(str(tmp_path / "t"))
    recent = filters.filter_recent(spark.read.parquet(str(tmp_path / "t")), 3)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,ScalarSubquery" in plan.replace(" ", "") or "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual" in plan
    assert recent.count() == 4
    assert recent.agg({"created_at": "min"}).first()[0] == NOON - dt.timedelta(hours=3)
