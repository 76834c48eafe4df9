"""Text, identifier, timestamp and prefilter expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.registry import query
from voxledger.functions import display as D
from voxledger.functions import text as X
from voxledger.functions import timeparse as P
from voxledger.operators import filters
from voxledger.operators.enrichment import route_empty_text
from voxledger.sources.driver_tables import table

# What the page tables hold in entities, decoded with '&' last.
DECODED = "html"
for _name, _char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("amp", "&")):
    DECODED = f"replace({DECODED}, '&{_name};', '{_char}')"


def body_sql(html: str = "html") -> str:
    text = DECODED.replace("html", f"regexp_replace({html}, '<[^>]+>', ' ', 'g')")
    text = f"regexp_replace({text}, '\\[link\\]|\\[comments\\]', '', 'gi')"
    text = f"regexp_replace({text}, 'submitted by.*', '', 'gi')"
    return f"trim(regexp_replace({text}, '[\\s\\x{{a0}}]+', ' ', 'g'))"


def post_content(html: str = "html"):
    """Page markup in the wrapping that feeds put around a post."""
    return F.concat(
        F.lit("<!-- SC_OFF -->"), F.col(html), F.lit('<!-- SC_ON --> submitted by <a href="/u/x">x</a> [link] [comments]')
    )


@query(
    "clean_text",
    f"""SELECT 'documents' AS origin, doc_id AS id, {Q.clean('text')} AS clean_text FROM documents
    UNION ALL SELECT 'pages', page_id, {Q.clean('html')} FROM pages
    UNION ALL SELECT 'conversations', conv_id * 1000 + turn, {Q.clean('text')} FROM conversations""",
)
def _(spark, sf_dir):
    def part(name, key, text):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), key.alias("id"), X.clean_text(F.col(text)).alias("clean_text")
        )

    turns = F.col("conv_id") * 1000 + F.col("turn")
    return (
        part("documents", F.col("doc_id"), "text")
        .unionByName(part("pages", F.col("page_id"), "html"))
        .unionByName(part("conversations", turns, "text"))
    )


@query("extract_post_body", f"SELECT page_id, {body_sql()} AS body FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.post_body(post_content()).alias("body"))


@query(
    "normalize_external_id",
    "SELECT page_id, 'reddit_' || replace(split_part(url || 't3_x', '/', -1), 't3_', '') AS external_id FROM pages",
)
def _(spark, sf_dir):
    raw_id = F.concat(F.col("url"), F.lit("t3_x"))
    return table(spark, sf_dir, "pages").select("page_id", X.external_id(raw_id).alias("external_id"))


@query(
    "merge_title_body",
    f"""WITH d AS (SELECT doc_id, ' ' || source || ' ' AS title, {Q.clean('text')} AS body FROM documents
      UNION ALL SELECT -1 - doc_id, ' ' || source || ' ', '' FROM documents)
    SELECT doc_id, CASE WHEN body <> '' THEN trim(title) || ' - ' || body ELSE trim(title) END AS raw_text FROM d""",
)
def _(spark, sf_dir):
    title = F.concat(F.lit(" "), F.col("source"), F.lit(" "))
    docs = table(spark, sf_dir, "documents")
    whole = docs.select("doc_id", title.alias("title"), X.clean_text(F.col("text")).alias("body"))
    bare = docs.select((-1 - F.col("doc_id")).alias("doc_id"), title.alias("title"), F.lit("").alias("body"))
    return whole.unionByName(bare).select("doc_id", X.merge_title_body(F.col("title"), F.col("body")).alias("raw_text"))


@query(
    "parse_iso_timestamp",
    """WITH e AS (SELECT event_id, event_id % 6 AS form, ts FROM events)
    SELECT event_id, form <> 5 AS parse_ok,
      CASE form WHEN 3 THEN date_trunc('day', ts) WHEN 2 THEN ts - INTERVAL 330 MINUTE
        WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN TIMESTAMP '2030-01-01 00:00:00' ELSE ts END::TIMESTAMP AS parsed
    FROM e""",
)
def _(spark, sf_dir):
    form, ts = F.col("event_id") % 6, F.col("ts")
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(form == 0, F.concat(stamp, F.lit("+00:00")))
        .when(form == 1, F.concat(stamp, F.lit("Z")))
        .when(form == 2, F.concat(stamp, F.lit("+05:30")))
        .when(form == 3, F.date_format(ts, "yyyy-MM-dd"))
        .when(form == 4, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .otherwise(F.concat(F.lit("around "), stamp))
    )
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        P.try_parse_iso(text).isNotNull().alias("parse_ok"),
        P.parse_iso(text, now).cast("timestamp_ntz").alias("parsed"),
    )


@query(
    "truncate_text",
    """SELECT doc_id, substring(text, 1, 1000) AS batch_text, substring(text, 1, 2000) AS row_text FROM documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.truncate(F.col("text"), 1000).alias("batch_text"),
        X.truncate(F.col("text"), 2000).alias("row_text"),
    )


@query(
    "accept_title",
    """WITH e AS (SELECT event_id, event_type AS fallback, CASE event_id % 5
        WHEN 0 THEN '  "Failures of ' || event_type || '" ' WHEN 1 THEN ' "" ' WHEN 2 THEN repeat(event_type, 30)
        WHEN 3 THEN NULL ELSE 'Plain ' || event_type END AS answer FROM events),
    t AS (SELECT *, trim(trim(trim(answer), '"')) AS title FROM e)
    SELECT event_id, CASE WHEN title <> '' AND length(title) < 100 THEN title ELSE fallback END AS title FROM t""",
)
def _(spark, sf_dir):
    form, kind = F.col("event_id") % 5, F.col("event_type")
    answer = (
        F.when(form == 0, F.concat(F.lit('  "Failures of '), kind, F.lit('" ')))
        .when(form == 1, ' "" ')
        .when(form == 2, F.repeat(kind, 30))
        .when(form == 4, F.concat(F.lit("Plain "), kind))
    )
    return table(spark, sf_dir, "events").select("event_id", D.accept_title(answer, kind).alias("title"))


NOISY = f"""noisy AS (SELECT doc_id, text AS raw_text FROM documents UNION ALL
    SELECT -1 - doc_id, CASE doc_id % 10 WHEN 0 THEN 'ok ... !!' WHEN 1 THEN repeat('@someone ', 6) || text
    WHEN 2 THEN 'https://example.com/' || doc_id ELSE repeat('@someone ', 5) || text END FROM documents WHERE doc_id % 10 < 4),
  cleaned AS (SELECT *, {Q.clean('raw_text')} AS clean_text FROM noisy)"""


@query(
    "prefilter_noise",
    f"""WITH {NOISY} SELECT doc_id, clean_text FROM cleaned WHERE clean_text <> ''
      AND len(regexp_extract_all(raw_text, '@[\\w\\p{{L}}]+')) <= 5
      AND len(regexp_extract_all(regexp_replace(clean_text, '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\S+')) >= 3""",
)
def _(spark, sf_dir):
    form, text = F.col("doc_id") % 10, F.col("text")
    raw = (
        F.when(form == 0, "ok ... !!")
        .when(form == 1, F.concat(F.repeat(F.lit("@someone "), 6), text))
        .when(form == 2, F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")))
        .otherwise(F.concat(F.repeat(F.lit("@someone "), 5), text))
    )
    docs = table(spark, sf_dir, "documents")
    noise = docs.filter(form < 4).select((-1 - F.col("doc_id")).alias("doc_id"), raw.alias("raw_text"))
    noisy = docs.select("doc_id", text.alias("raw_text")).unionByName(noise)
    noisy = noisy.withColumn("clean_text", X.clean_text_once(F.col("raw_text")))
    return filters.drop_noise(noisy).select("doc_id", "clean_text")


@query(
    "prefilter_posts",
    "SELECT doc_id, lang FROM documents WHERE lang = 'en' AND NOT doc_id % 6 = 0 AND NOT n_chars % 7 = 0",
)
def _(spark, sf_dir):
    posts = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        (F.col("doc_id") % 6 == 0).alias("is_repost"),
        (F.col("n_chars") % 7 == 0).alias("is_promoted"),
    )
    return filters.keep_original_posts(posts).select("doc_id", "lang")


@query(
    "route_empty_text",
    f"""WITH d AS (SELECT doc_id AS id, {Q.clean('text')} AS clean_text FROM documents UNION ALL SELECT -1 - doc_id, '  ' FROM documents)
    SELECT id, clean_text, trim(clean_text) <> '' AS needs_model,
      CASE WHEN trim(clean_text) = '' THEN 'Uncategorized' END AS category,
      CASE WHEN trim(clean_text) = '' THEN 'Neutral' END AS sentiment,
      CASE WHEN trim(clean_text) = '' THEN 1 END AS urgency_score FROM d""",
)
def _(spark, sf_dir):
    docs, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    whole = docs.select(doc.alias("id"), X.clean_text(F.col("text")).alias("clean_text"))
    return route_empty_text(whole.unionByName(docs.select((-1 - doc).alias("id"), F.lit("  ").alias("clean_text"))))
