"""Filters, aggregates and dashboard queries over the feedback view."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.registry import query
from voxledger.functions import display as D
from voxledger.functions.numeric import half_even, pct_change
from voxledger.operators import filters, metrics, priority
from voxledger.plans import dashboard
from voxledger.sources.driver_tables import feedback, feedback_text

FB = f"WITH {Q.CTE_FB} "
FBT = f"WITH {Q.CTE_FBT} "

SEARCH = r"(erro|und)\S* (th|de)"


@query("filter_recent", FB + f"SELECT id, created_at FROM fb WHERE {Q.recent('fb', 168)}")
def _(spark, sf_dir):
    return filters.filter_recent(feedback(spark, sf_dir), 168).select("id", "created_at")


@query(
    "filter_facets",
    FB + "SELECT id, category, sentiment, source FROM fb WHERE category = 'Bug' AND source = 'tweet'",
)
def _(spark, sf_dir):
    kept = filters.filter_facets(feedback(spark, sf_dir), category="Bug", sentiment="", source="tweet")
    return kept.select("id", "category", "sentiment", "source")


@query(
    "filter_multiselect",
    FB + "SELECT id, category, sentiment, source FROM fb "
    "WHERE category IN ('Bug', 'Praise') AND source IN ('tweet', 'play_store')",
)
def _(spark, sf_dir):
    kept = filters.filter_multiselect(feedback(spark, sf_dir), ["Bug", "Praise"], [], ["tweet", "play_store"])
    return kept.select("id", "category", "sentiment", "source")


@query("search_text", FBT + f"SELECT id, category FROM fbt WHERE regexp_matches(lower(clean_text), '{SEARCH.lower()}')")
def _(spark, sf_dir):
    return filters.search_text(feedback_text(spark, sf_dir), SEARCH).select("id", "category")


@query("filter_incident_categories", FB + "SELECT id, category FROM fb WHERE category IN ('Bug', 'Complaint')")
def _(spark, sf_dir):
    return filters.filter_incident_categories(feedback(spark, sf_dir)).select("id", "category")


@query("category_volume", FB + "SELECT category, count(*) AS volume FROM fb GROUP BY category")
def _(spark, sf_dir):
    return priority.category_volume(feedback(spark, sf_dir))


@query("priority_score", FB + f", {Q.scored('fb')} SELECT id, category, urgency_score, priority_score FROM scored")
def _(spark, sf_dir):
    return priority.score(feedback(spark, sf_dir)).select("id", "category", "urgency_score", "priority_score")


@query(
    "split_windows",
    FB + """, hi AS (SELECT max(created_at) AS m FROM fb)
    SELECT id, created_at, CASE WHEN created_at >= m - INTERVAL 240 HOUR THEN 'current' ELSE 'previous' END AS period
    FROM fb, hi WHERE created_at >= m - INTERVAL 480 HOUR""",
)
def _(spark, sf_dir):
    return metrics.split_windows(feedback(spark, sf_dir), 240).select("id", "created_at", "period")


def _kpi_sql(hours: int) -> str:
    def measures(period: str, mark: str) -> str:
        inside = f"period = '{period}'"
        return f"""count(*) FILTER ({inside})::DOUBLE AS total_{mark},
          count(*) FILTER ({inside} AND category = 'Bug')::DOUBLE AS bugs_{mark},
          coalesce({Q.half_even(f"count(*) FILTER ({inside} AND sentiment = 'Negative') / nullif(count(*) FILTER ({inside}), 0)::DOUBLE * 100", 1)}, 0.0) AS neg_{mark},
          coalesce({Q.half_even(f"avg(urgency_score) FILTER ({inside})", 1)}, 0.0) AS urg_{mark}"""

    arms = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{metric}' AS metric, {name}_c AS value, {Q.pct_change(name + '_c', name + '_p')} AS delta_pct FROM wide"
        for i, (metric, name) in enumerate(
            [("total_feedback", "total"), ("bugs_reported", "bugs"), ("negative_rate", "neg"), ("avg_urgency", "urg")]
        )
    )
    return f"""WITH {Q.CTE_FB}, hi AS (SELECT max(created_at) AS m FROM fb),
      marked AS (SELECT fb.*, CASE WHEN created_at >= m - INTERVAL {hours} HOUR THEN 'current' ELSE 'previous' END AS period
                 FROM fb, hi WHERE created_at >= m - INTERVAL {2 * hours} HOUR),
      wide AS (SELECT {measures('current', 'c')}, {measures('previous', 'p')} FROM marked),
      kpi AS ({arms})"""


@query("kpis", _kpi_sql(240) + " SELECT * FROM kpi")
def _(spark, sf_dir):
    return metrics.kpis(feedback(spark, sf_dir), 240)


@query(
    "pct_change",
    FB + f""", daily AS (SELECT date_trunc('day', created_at)::TIMESTAMP AS day,
        count(*) FILTER (category = 'Bug') AS bugs, count(*) FILTER (category = 'Praise') AS praises FROM fb GROUP BY 1)
    SELECT day, {Q.pct_change('bugs', 'praises')} AS change_pct FROM daily""",
)
def _(spark, sf_dir):
    day = F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day")
    daily = feedback(spark, sf_dir).groupBy(day).agg(
        F.count_if(F.col("category") == "Bug").alias("bugs"), F.count_if(F.col("category") == "Praise").alias("praises")
    )
    return daily.select("day", pct_change(F.col("bugs"), F.col("praises")).alias("change_pct"))


def _hourly_sql(hours: int) -> str:
    return f"""win AS (SELECT * FROM fb WHERE {Q.recent('fb', hours)}),
      counted AS (SELECT date_trunc('hour', created_at) AS hour, count(*) AS n FROM win GROUP BY 1),
      spine AS (SELECT unnest(generate_series((SELECT min(hour) FROM counted), (SELECT max(hour) FROM counted), INTERVAL 1 HOUR)) AS hour),
      hourly AS (SELECT spine.hour::TIMESTAMP AS hour, coalesce(n, 0)::BIGINT AS count FROM spine LEFT JOIN counted USING (hour)),
      timeline AS (SELECT hour, strftime(hour, '%H:%M') AS time, strftime(hour, '%Y-%m-%dT%H:%M:%S') AS iso_time, count,
                          {Q.half_even('(SELECT avg(count) FROM hourly)', 1)} AS baseline FROM hourly),
      top AS (SELECT hour AS peak_hour, count AS peak_count, (SELECT avg(count) FROM hourly) AS b
              FROM hourly ORDER BY count DESC, hour LIMIT 1),
      peak AS (SELECT strftime(peak_hour, '%H:%M') AS peak_time, peak_hour, peak_count,
                      {Q.half_even('(peak_count - b) / b * 100')}::BIGINT AS pct_above_baseline FROM top
               WHERE b > 0 AND peak_count >= 3 AND peak_count > b * 1.5),
      labelled AS (SELECT *, 'Spike Detected: ~' || peak_time || ' (+' || pct_above_baseline || '% above norm)' AS label FROM peak)"""


@query("hourly_volume", FB + f", {_hourly_sql(168)} SELECT hour, count FROM hourly")
def _(spark, sf_dir):
    return metrics.hourly_volume(feedback(spark, sf_dir), 168)


@query("volume_baseline", FB + f", {_hourly_sql(720)} SELECT hour, count, baseline FROM timeline")
def _(spark, sf_dir):
    return metrics.with_volume_baseline(metrics.hourly_volume(feedback(spark, sf_dir), 720))


@query("peak_annotation", FB + f", {_hourly_sql(720)} SELECT * FROM labelled")
def _(spark, sf_dir):
    return metrics.peak_annotation(metrics.hourly_volume(feedback(spark, sf_dir), 720))


SENTIMENT_SQL = f"""dim AS (SELECT * FROM (VALUES (0, 'Negative'), (1, 'Neutral'), (2, 'Positive')) d(ord, sentiment)),
  dist AS (SELECT ord, dim.sentiment, count(win.id) AS count FROM dim LEFT JOIN win ON win.sentiment = dim.sentiment GROUP BY 1, 2),
  shared AS (SELECT *, coalesce({Q.half_even('count / nullif((SELECT sum(count) FROM dist), 0)::DOUBLE * 100', 1)}, 0.0) AS percentage FROM dist)"""


@query("sentiment_distribution", FB + f", win AS (SELECT * FROM fb), {SENTIMENT_SQL} SELECT ord, sentiment, count FROM dist")
def _(spark, sf_dir):
    return metrics.sentiment_distribution(feedback(spark, sf_dir))


@query("sentiment_share", FB + f", win AS (SELECT * FROM fb WHERE {Q.recent('fb', 24)}), {SENTIMENT_SQL} SELECT * FROM shared")
def _(spark, sf_dir):
    return dashboard.sentiment_chart(feedback(spark, sf_dir), 24)


@query("source_breakdown", FB + "SELECT source, count(*) AS count FROM fb GROUP BY source")
def _(spark, sf_dir):
    return metrics.source_breakdown(feedback(spark, sf_dir))


SHARE_SQL = """src AS (SELECT source, count(*) AS count FROM win GROUP BY source),
  share AS (SELECT source, count, count / greatest((SELECT max(count) FROM src), 1)::DOUBLE * 100 AS share_pct FROM src)"""


@query("share_of_max", FB + f", win AS (SELECT * FROM fb), {SHARE_SQL} SELECT * FROM share")
def _(spark, sf_dir):
    return metrics.share_of_max(metrics.source_breakdown(feedback(spark, sf_dir)))


FACETS_SQL = (
    "SELECT DISTINCT 'category' AS facet, category AS value FROM fb UNION ALL SELECT DISTINCT 'source', source FROM fb"
)


@query("facet_values", FB + FACETS_SQL)
def _(spark, sf_dir):
    return metrics.facet_values(feedback(spark, sf_dir))


@query(
    "baseline_rate",
    FB + ", span AS (SELECT (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 / 60 AS minutes FROM fb) "
    "SELECT category, count(*) AS category_total, count(*) / minutes * 60 AS baseline "
    "FROM fb, span WHERE category IN ('Bug', 'Complaint') GROUP BY category, minutes",
)
def _(spark, sf_dir):
    return metrics.baseline_rate(feedback(spark, sf_dir))


@query(
    "source_label",
    FB + f"""SELECT id, {Q.label('source', 'chart')} AS chart_label, {Q.label('source')} AS ticket_label,
       {Q.label('source', 'backlog')} AS backlog_label FROM fb""",
)
def _(spark, sf_dir):
    source = F.col("source")
    return feedback(spark, sf_dir).select(
        "id",
        D.source_label(source, "chart").alias("chart_label"),
        D.source_label(source, "ticket").alias("ticket_label"),
        D.source_label(source, "backlog").alias("backlog_label"),
    )


@query(
    "format_fields",
    FB + """, d AS (SELECT *, CASE WHEN urgency_score <> 1 THEN (urgency_score - 3) * 12.5::DOUBLE END AS pct FROM fb)
    SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS minute_text, strftime(created_at, '%H:%M') AS clock_text,
      strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso_text,
      CASE WHEN pct >= 0 THEN '+' ELSE '' END || pct || '%' AS delta_text FROM d""",
)
def _(spark, sf_dir):
    created, urgency = F.col("created_at"), F.col("urgency_score")
    pct = F.when(urgency != 1, (urgency - 3) * F.lit(12.5))
    return feedback(spark, sf_dir).select(
        "id",
        D.minute_text(created).alias("minute_text"),
        D.clock_text(created).alias("clock_text"),
        D.iso_text(created).alias("iso_text"),
        D.delta_text(pct).alias("delta_text"),
    )


HOURLY_URGENCY = f"""grp AS (SELECT category, date_trunc('hour', created_at)::TIMESTAMP AS hour,
    {Q.half_even('avg(urgency_score)', 1)} AS avg_urgency FROM fb GROUP BY 1, 2)"""


def _hourly_urgency(spark, sf_dir):
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")
    grouped = feedback(spark, sf_dir).groupBy("category", hour)
    return grouped.agg(half_even(F.avg("urgency_score"), 1).alias("avg_urgency"))


@query(
    "severity",
    FB + f", {HOURLY_URGENCY} SELECT *, CASE WHEN avg_urgency >= 4 THEN 'Critical' ELSE 'High' END AS severity FROM grp",
)
def _(spark, sf_dir):
    return _hourly_urgency(spark, sf_dir).withColumn("severity", D.severity(F.col("avg_urgency")))


@query(
    "ticket_text",
    FB + """, t AS (SELECT id + 1 AS number, category, CASE WHEN urgency_score >= 4 THEN 'Critical' ELSE 'High' END AS level FROM fb),
    n AS (SELECT *, CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS digits FROM t)
    SELECT number, 'TIQ-' || digits AS ticket_id, 'TIQ-JIRA-' || digits AS tracker_key,
           level || ' Priority: Spike in ''' || category || ''' reports' AS title FROM n""",
)
def _(spark, sf_dir):
    numbered = feedback(spark, sf_dir).withColumn("ticket_id", D.ticket_id(F.col("id") + 1))
    level = D.severity(F.col("urgency_score"))
    return numbered.select(
        (F.col("id") + 1).alias("number"),
        "ticket_id",
        D.tracker_key(F.col("ticket_id")).alias("tracker_key"),
        D.ticket_title(level, F.col("category")).alias("title"),
    )


@query(
    "metadata",
    FB + f""", facets AS ({FACETS_SQL})
    SELECT facet AS kind, value AS label, NULL::BIGINT AS value FROM facets
    UNION ALL SELECT * FROM (VALUES ('sentiment', 'Negative', NULL::BIGINT), ('sentiment', 'Neutral', NULL),
      ('sentiment', 'Positive', NULL), ('time_window', 'All Time', 720), ('time_window', 'Last 7 Days', 168),
      ('time_window', 'Last 24 Hours', 24)) v
    UNION ALL SELECT 'total_records', '', count(*) FROM fb""",
)
def _(spark, sf_dir):
    return dashboard.metadata(feedback(spark, sf_dir))


@query(
    "kpi_cards",
    _kpi_sql(360) + """ SELECT *, CASE metric WHEN 'total_feedback' THEN 'vs previous period' WHEN 'bugs_reported' THEN 'spike'
      WHEN 'negative_rate' THEN 'vs baseline' ELSE '/ 5 vs baseline' END AS subtext,
      CASE WHEN delta_pct >= 0 THEN '+' ELSE '' END || delta_pct || '%' AS delta_text FROM kpi""",
)
def _(spark, sf_dir):
    return dashboard.kpi_cards(feedback(spark, sf_dir), 360)


@query("charts_volume", FB + f", {_hourly_sql(720)} SELECT * FROM timeline")
def _(spark, sf_dir):
    return dashboard.volume_timeline(feedback(spark, sf_dir))


@query("charts_peak", FB + f", {_hourly_sql(168)} SELECT * FROM labelled")
def _(spark, sf_dir):
    return dashboard.volume_peak(feedback(spark, sf_dir), 168)


@query("charts_sentiment", FB + f", win AS (SELECT * FROM fb WHERE {Q.recent('fb', 720)}), {SENTIMENT_SQL} SELECT * FROM shared")
def _(spark, sf_dir):
    return dashboard.sentiment_chart(feedback(spark, sf_dir))


@query(
    "charts_source",
    FB + f""", win AS (SELECT * FROM fb WHERE {Q.recent('fb', 720)}), {SHARE_SQL}
    SELECT source AS source_key, {Q.label('source', 'chart')} AS source, count, share_pct FROM share""",
)
def _(spark, sf_dir):
    return dashboard.source_chart(feedback(spark, sf_dir))


@query(
    "charts",
    FB + f""", {_hourly_sql(720)}, {SENTIMENT_SQL}, {SHARE_SQL}
    SELECT 'volume' AS chart, iso_time AS label, count, baseline AS value FROM timeline
    UNION ALL SELECT 'peak', label, peak_count, pct_above_baseline::DOUBLE FROM labelled
    UNION ALL SELECT 'sentiment', sentiment, count, percentage FROM shared
    UNION ALL SELECT 'source', {Q.label('source', 'chart')}, count, share_pct FROM share""",
)
def _(spark, sf_dir):
    return dashboard.charts(feedback(spark, sf_dir))
