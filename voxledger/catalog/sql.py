"""SQL fragments shared by the twins of the queries."""

from __future__ import annotations

from voxledger import schema as S

EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+"


def clean(text: str) -> str:
    for pattern in ("<[^>]+>", r"https?://\S+|www\.\S+", EMOJI, r"\s+"):
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return f"coalesce(trim({text}), '')"


def half_even(value: str, digits: int = 0) -> str:
    return f"(round_even(({value}) * {10**digits}.0::DOUBLE, 0) / {10**digits}.0::DOUBLE)"


def pct_change(current: str, previous: str) -> str:
    change = half_even(f"({current} - {previous}) / ({previous})::DOUBLE * 100", 1)
    return f"CASE WHEN {previous} = 0 THEN NULL ELSE {change} END"


def case(column: str, values: dict[str, object], other: str) -> str:
    arms = " ".join(f"WHEN '{key}' THEN {value!r}" for key, value in values.items())
    return f"CASE {column} {arms} ELSE {other} END"


FEEDBACK = """
SELECT event_id AS id,
       CASE user_id % 4 WHEN 0 THEN 'app_review' WHEN 1 THEN 'play_store'
                        WHEN 2 THEN 'tweet' ELSE 'support_ticket' END AS source,
       ts AS created_at,
       CASE event_type WHEN 'error' THEN 'Bug' WHEN 'click' THEN 'Complaint'
                       WHEN 'signup' THEN 'Feature Request' WHEN 'view' THEN 'Praise'
                       ELSE 'Spam' END AS category,
       CASE WHEN k % 3 = 0 THEN 'Neutral'
            WHEN event_type IN ('error','click') THEN 'Negative'
            WHEN event_type = 'view' THEN 'Positive' ELSE 'Neutral' END AS sentiment,
       CAST(1 + k % 5 AS INT) AS urgency_score
FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
"""

CTE_FB = f"fb AS ({FEEDBACK})"

CTE_FBT = f"""{CTE_FB},
docs AS (SELECT doc_id, text AS raw_text, {clean('text')} AS clean_text FROM documents),
fbt AS (SELECT fb.*, docs.raw_text, docs.clean_text
        FROM fb JOIN docs ON docs.doc_id = fb.id % (SELECT count(*) FROM documents))"""


def scored(table: str, name: str = "scored") -> str:
    """CTE that adds ``priority_score`` to a table."""
    weight = case("category", S.CATEGORY_WEIGHTS, "0.5")
    score = half_even(f"urgency_score * CAST({weight} AS DOUBLE) * (1 + sqrt(volume) / 10)", 2)
    return f"""{name} AS (
      SELECT t.*, {score} AS priority_score
      FROM {table} t JOIN (SELECT category, count(*) AS volume FROM {table} GROUP BY category) v USING (category))"""


def recent(table: str, hours: int) -> str:
    return f"created_at >= (SELECT max(created_at) FROM {table}) - INTERVAL {hours} HOUR"


CTE_WINDOWS = """
inc AS (SELECT *, epoch_us(created_at) AS us FROM fb WHERE category IN ('Bug', 'Complaint')),
ahead AS (SELECT category, us,
                 count(*) OVER (PARTITION BY category ORDER BY us
                                RANGE BETWEEN CURRENT ROW AND 3600000000 FOLLOWING) AS n FROM inc),
q AS (SELECT DISTINCT category, us FROM ahead WHERE n >= 5),
nx AS (SELECT category, us, min(us) OVER (PARTITION BY category ORDER BY us
              RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM q),
chain AS (SELECT category, min(us) AS start_us FROM q GROUP BY category
          UNION ALL
          SELECT nx.category, nx.next_us FROM chain JOIN nx
          ON nx.category = chain.category AND nx.us = chain.start_us WHERE nx.next_us IS NOT NULL)"""

CTE_TICKETS = f"""{CTE_WINDOWS},
members AS (SELECT inc.*, chain.start_us FROM inc JOIN chain
            ON inc.category = chain.category AND inc.us BETWEEN chain.start_us AND chain.start_us + 3600000000),
span AS (SELECT (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6 / 60 AS minutes FROM fb),
base AS (SELECT category, count(*) AS category_total,
                CASE WHEN minutes > 0 THEN count(*) / minutes * 60 ELSE 0.0 END AS baseline
         FROM fb, span WHERE category IN ('Bug', 'Complaint') GROUP BY category, minutes),
grouped AS (SELECT category, start_us, count(*) AS affected_count,
                   {half_even('avg(urgency_score)', 1)} AS avg_urgency,
                   min(created_at) AS window_start, max(created_at) AS window_end
            FROM members GROUP BY category, start_us),
tickets AS (SELECT g.*, CASE WHEN avg_urgency >= 4 THEN 'Critical' ELSE 'High' END AS severity,
                   CASE WHEN baseline > 0 THEN
                     CAST({half_even('(affected_count - baseline) / baseline * 100')} AS BIGINT) END AS pct_above_baseline,
                   row_number() OVER (ORDER BY g.category, start_us) AS number,
                   sha256(g.category || '|' || start_us) AS ticket_key
            FROM grouped g JOIN base USING (category)),
titled AS (SELECT *, 'TIQ-' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS ticket_id,
                  severity || ' Priority: Spike in ''' || category || ''' reports' AS title FROM tickets)"""


def label(source: str, style: str = "ticket") -> str:
    tweet = "Twitter / X" if style == "chart" else "Twitter"
    return (
        f"CASE {source} WHEN 'app_review' THEN 'App Store' WHEN 'play_store' THEN 'Play Store' "
        f"WHEN 'tweet' THEN '{tweet}' WHEN 'support_ticket' THEN 'Support Ticket' ELSE {source} END"
    )
