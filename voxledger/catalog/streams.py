"""Structured Streaming jobs, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.incidents import WINDOWS
from voxledger.catalog.keyword_answers import keyword_answers
from voxledger.catalog.labels import SEEN, keyword_case
from voxledger.catalog.registry import query
from voxledger.catalog.sources import FEED, SUBMISSIONS, landed_feeds, landed_submissions
from voxledger.session import drop_shuffles, scratch, scratch_folder, scratch_path
from voxledger.sources.driver_tables import SCHEMAS, as_feedback, table
from voxledger.sources.feedback_table import create_feedback_table
from voxledger.streaming.ingest import stream_ingest, stream_posts
from voxledger.streaming.spikes import SpikeStream
from voxledger.streaming.volume import read_hourly_volume, stream_hourly_volume

# Deliveries end at these days; the first also holds what is older or has no time, the last all that is newer.
DAYS = ("2024-01-11", "2024-01-21")


def _deliveries(spark: SparkSession, sf_dir: str, landing: str):
    """Land the events in deliveries, yielding after each."""
    events = table(spark, sf_dir, "events")
    number = sum((F.col("ts") >= F.lit(day)).cast("int") for day in DAYS)
    for delivery in range(len(DAYS) + 1):
        part = events.filter(F.coalesce(number, F.lit(0)) == delivery)
        part.write.mode("append").parquet(landing)
        yield


def _landed(spark: SparkSession, landing: str) -> DataFrame:
    return as_feedback(spark.readStream.schema(SCHEMAS["events"]).parquet(landing))


@query(
    "stream_hourly_volume",
    f"WITH {Q.CTE_FB} SELECT date_trunc('hour', created_at)::TIMESTAMP AS hour, count(*) AS count FROM fb GROUP BY 1",
)
def _(spark, sf_dir):
    landing, out, checkpoint = (scratch_path(spark, kind) for kind in ("landing", "volume", "offsets"))
    for _ in _deliveries(spark, sf_dir, landing):
        stream_hourly_volume(_landed(spark, landing), out, checkpoint).awaitTermination()
    return read_hourly_volume(spark, out)


@query("stream_spikes", WINDOWS + "SELECT category, start_us, make_timestamp(start_us) AS window_start FROM chain")
def _(spark, sf_dir):
    landing, root, checkpoint = (scratch_path(spark, kind) for kind in ("landing", "spikes", "offsets"))
    stream = SpikeStream(root, checkpoint)
    for _ in _deliveries(spark, sf_dir, landing):
        stream.start(_landed(spark, landing)).awaitTermination()
    return stream.closed_windows(spark).unionByName(stream.open_windows(spark))


@query(
    "stream_ingest",
    f"""WITH src AS (SELECT doc_id AS id, 'd' || doc_id AS external_id, text AS raw_text, {Q.clean('text')} AS clean_text FROM documents),
      s AS (SELECT *, {SEEN} FROM src)
    SELECT id, external_id, raw_text, clean_text, {keyword_case(0)} AS category, {keyword_case(1)} AS sentiment,
      {keyword_case(2)} AS urgency_score FROM s""",
)
def _(spark, sf_dir):
    landing = scratch_path(spark, "landing")
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit("tweet").alias("source"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("external_id"),
        F.col("text").alias("raw_text"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"),
    )
    raw.write.parquet(landing)
    path = scratch_path(spark, "feedback")
    name = "feedback_" + path[-12:]
    create_feedback_table(spark, name, path)
    # The second run has lost its offsets and is handed everything again.
    for _ in range(2):
        stream = spark.readStream.schema(raw.schema).parquet(landing)
        stream_ingest(stream, keyword_answers, name, scratch_path(spark, "offsets")).awaitTermination()
    spark.catalog.refreshTable(name)
    columns = ("id", "external_id", "raw_text", "clean_text", "category", "sentiment", "urgency_score")
    stored = spark.table(name).select(*columns)
    spark.sql(f"DROP TABLE {name}")
    return stored


@query(
    "stream_posts",
    f"""WITH {FEED}, {SUBMISSIONS}, src AS (
      SELECT 'reddit_' || post AS external_id, CASE WHEN body <> '' THEN title || ' - ' || body ELSE title END AS raw_text, posted_at FROM p
      UNION ALL SELECT 'reddit_' || id, CASE WHEN body <> '' THEN title || ' - ' || trim(body, E' \\t\\n\\r') ELSE title END, posted_at FROM posts),
      c AS (SELECT *, {Q.clean('raw_text')} AS clean_text FROM src), s AS (SELECT *, {SEEN} FROM c)
    SELECT external_id, raw_text, clean_text, posted_at AS created_at, {keyword_case(0)} AS category, {keyword_case(1)} AS sentiment,
      {keyword_case(2)} AS urgency_score FROM s""",
)
def _(spark, sf_dir):
    """Two deliveries; the second shows half the feeds and all submissions once more."""
    feeds, posts = landed_feeds(spark, sf_dir), landed_submissions(spark, sf_dir)
    table_path, checkpoint = scratch_path(spark, "feedback"), scratch_path(spark, "offsets")
    name = "feedback_" + table_path[-12:]
    create_feedback_table(spark, name, table_path)
    with scratch(spark):
        landing = scratch_folder(spark, "landing")
        for part in (feeds.filter("feed % 2 = 0"), feeds):
            with drop_shuffles(spark):
                part.write.mode("append").parquet(f"{landing}/feeds")
            posts.write.mode("append").parquet(f"{landing}/posts")
            landed = (spark.readStream.schema(df.schema).parquet(f"{landing}/{kind}") for kind, df in (("feeds", feeds), ("posts", posts)))
            stream_posts(*landed, keyword_answers, name, checkpoint).awaitTermination()
    spark.catalog.refreshTable(name)
    stored = spark.table(name).select("external_id", "raw_text", "clean_text", "created_at", "category", "sentiment", "urgency_score")
    spark.sql(f"DROP TABLE {name}")
    return stored
