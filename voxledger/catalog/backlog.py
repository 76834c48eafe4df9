"""Ranking, paging and the backlog."""

from __future__ import annotations

from voxledger.catalog import sql as Q
from voxledger.catalog.registry import query
from voxledger.operators import ordering, priority
from voxledger.plans import backlog as B
from voxledger.session import scratch_path
from voxledger.sources.driver_tables import feedback, feedback_text
from voxledger.sources.feedback_table import read_csv

FB = f"WITH {Q.CTE_FB}, {Q.scored('fb')} "
FBT = f"WITH {Q.CTE_FBT}, {Q.scored('fbt')} "
ORDER = "ORDER BY priority_score DESC, id"
EXPORT_TYPE = (
    "priority_score double, category string, sentiment string, urgency_score int, "
    "source string, clean_text string, created_at timestamp_ntz"
)
EXPORT = "priority_score, category, sentiment, urgency_score, source, clean_text, created_at"


@query(
    "rank_feedback",
    FB + f"SELECT id, category, priority_score, row_number() OVER ({ORDER}) - 1 AS rank FROM scored",
)
def _(spark, sf_dir):
    ranked = ordering.with_rank(priority.score(feedback(spark, sf_dir)))
    return ranked.select("id", "category", "priority_score", "rank")


@query("top_n", FB + f"SELECT id, category, priority_score FROM scored {ORDER} LIMIT 100")
def _(spark, sf_dir):
    return ordering.top_n(priority.score(feedback(spark, sf_dir))).select("id", "category", "priority_score")


@query("paginate", FB + f"SELECT id, category, priority_score FROM scored {ORDER} LIMIT 25 OFFSET 50")
def _(spark, sf_dir):
    page = ordering.paginate(priority.score(feedback(spark, sf_dir)), page=3, limit=25)
    return page.select("id", "category", "priority_score")


@query("paginate_deep", FB + f"SELECT id, category, priority_score FROM scored {ORDER} LIMIT 200 OFFSET 800")
def _(spark, sf_dir):
    """A page found by value, as those far down a large table are."""
    page = ordering.paginate(priority.score(feedback(spark, sf_dir)), page=5, limit=200, heap_rows=0)
    return page.select("id", "category", "priority_score")


@query("select_display", FBT + f"SELECT {EXPORT} FROM scored")
def _(spark, sf_dir):
    return B.select_display(priority.score(feedback_text(spark, sf_dir)))


@query(
    "backlog",
    FBT + f""", hit AS (SELECT * FROM scored WHERE {Q.recent('scored', 360)} AND sentiment = 'Negative'
        AND regexp_matches(lower(clean_text), 'en (th|de)'))
    SELECT id, priority_score, category, sentiment, urgency_score, {Q.label('source', 'backlog')} AS source,
      source AS raw_source, clean_text, strftime(created_at, '%Y-%m-%d %H:%M') AS created_at, 2 AS page, 25 AS "limit",
      (SELECT count(*) FROM hit) AS total, (SELECT ceil(count(*) / 25.0)::BIGINT FROM hit) AS total_pages
    FROM hit {ORDER} LIMIT 25 OFFSET 25""",
)
def _(spark, sf_dir):
    rows = feedback_text(spark, sf_dir)
    return B.backlog(rows, page=2, limit=25, sentiment="Negative", search="En (th|de)", hours=360)


@query("backlog_export", FBT + f"SELECT {EXPORT} FROM scored WHERE {Q.recent('scored', 168)} AND category = 'Bug'")
def _(spark, sf_dir):
    return B.backlog_export(feedback_text(spark, sf_dir), category="Bug", hours=168)


@query(
    "export_backlog_csv",
    FBT + f"SELECT {EXPORT} FROM scored WHERE {Q.recent('scored', 240)} AND source = 'tweet'",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "export")
    B.export_backlog_csv(feedback_text(spark, sf_dir), path, source="tweet", hours=240)
    return read_csv(spark, path, EXPORT_TYPE)
