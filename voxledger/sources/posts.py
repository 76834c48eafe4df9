"""Channel readers: landed feed documents, post lists and submission records.

Each takes a table of landed records and returns contract rows plus
``posted_at``, the instant the watermark is compared with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.functions import text as X
from voxledger.functions import timeparse as P

SOURCE = "reddit"

FEED_TYPE = (
    "entry array<struct<id: string, title: string, updated: string, "
    "content: struct<_VALUE: string, _type: string>>>"
)
# The record separator of JSON text sequences (RFC 7464), which JSON itself holds only escaped.
SEED_END = "\x1e"
SEED_TYPE = "array<struct<source: string, external_id: string, raw_text: string, created_at: string>>"


def newer_than(df: DataFrame, since: float | Column | None, ts: str = "posted_at") -> DataFrame:
    """Rows strictly newer than the mark (epoch seconds); no mark or 0 keeps all."""
    if since is None or (not isinstance(since, Column) and not since):
        return df
    mark = since if isinstance(since, Column) else F.lit(float(since))
    unset = F.coalesce(mark, F.lit(0.0)) == 0.0
    return df.filter(unset | (P.epoch_seconds(F.col(ts)) > mark))


def newest_mark(df: DataFrame, since: float | None = None, ts: str = "posted_at") -> DataFrame:
    """One row ``since_utc``: the newest instant seen, never older than the old mark."""
    newest = F.max(P.epoch_seconds(F.col(ts)))
    return df.agg(F.greatest(newest, F.lit(since).cast("double")).alias("since_utc"))


def parse_atom_feed(feeds: DataFrame, column: str = "xml", since: float | None = None) -> DataFrame:
    """Entries of Atom documents; those without id, title or update time are skipped.

    A document that does not parse yields no rows.
    """
    entries = feeds.select(F.inline(F.from_xml(F.col(column), FEED_TYPE, {"ignoreSurroundingSpaces": "false"})["entry"]))
    complete = entries.filter("id IS NOT NULL AND title IS NOT NULL AND updated IS NOT NULL")
    timed = complete.withColumn("posted_at", P.parse_iso(F.col("updated")))
    body = X.post_body(F.col("content._VALUE"))
    rows = timed.select(
        F.lit(SOURCE).alias("source"),
        X.external_id(F.col("id")).alias("external_id"),
        X.merge_title_body(F.col("title"), body).alias("raw_text"),
        P.iso_or_now(F.col("updated"), F.col("posted_at")).alias("created_at"),
        "posted_at",
    )
    return newer_than(rows, since)


def parse_seed_posts(
    documents: DataFrame, column: str = "json", limit: int = 25, since: float | None = None
) -> DataFrame:
    """Posts of JSON arrays. The first ``limit`` of each array count, before the watermark does."""
    items = documents.select(F.posexplode(F.from_json(F.col(column), SEED_TYPE)).alias("pos", "item"))
    items = items.filter(F.col("pos") < limit).select("pos", "item.*")
    timed = items.withColumn("posted_at", P.parse_iso(F.coalesce("created_at", F.lit(""))))
    whole_seconds = F.floor(P.epoch_seconds(F.col("posted_at"))).cast("string")
    rows = timed.select(
        F.lit(SOURCE).alias("source"),
        F.coalesce("external_id", F.concat(F.lit("reddit_"), whole_seconds)).alias("external_id"),
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("created_at", P.iso_utc(F.col("posted_at"))).alias("created_at"),
        "posted_at",
    )
    return newer_than(rows, since)


def read_seed_posts(spark: SparkSession, path: str, limit: int = 25, since: float | None = None) -> DataFrame:
    """Post lists from files that each hold one JSON array, or several parted by ``SEED_END``."""
    return parse_seed_posts(spark.read.text(path, lineSep=SEED_END), "value", limit, since)


def normalize_submissions(posts: DataFrame, since: float | None = None) -> DataFrame:
    """Submission records (id, title, selftext, created_utc, stickied) as contract rows."""
    kept = posts.filter(~F.coalesce("stickied", F.lit(False)))
    kept = kept.withColumn("posted_at", P.from_epoch_seconds(F.col("created_utc")))
    has_body = F.coalesce("selftext", F.lit("")) != ""
    title = X.strip(F.col("title"))
    rows = kept.select(
        F.lit(SOURCE).alias("source"),
        F.concat(F.lit("reddit_"), F.col("id")).alias("external_id"),
        F.when(has_body, F.concat(title, F.lit(" - "), X.strip(F.col("selftext")))).otherwise(title).alias("raw_text"),
        P.iso_utc(F.col("posted_at")).alias("created_at"),
        "posted_at",
        *(["channel"] if "channel" in posts.columns else []),
    )
    return newer_than(rows, since)
