"""Continuous ingest: at-least-once delivery made exact by the upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxledger import schema as S
from voxledger.operators.enrichment import Scorer
from voxledger.plans.ingest import upsert_run
from voxledger.session import STATE_STORE, drop_shuffles
from voxledger.sources.contract import union_sources
from voxledger.sources.posts import normalize_submissions, parse_atom_feed


def stream_ingest(raw: DataFrame, scorer: Scorer, table: str, checkpoint: str) -> StreamingQuery:
    """Clean, deduplicate, label and insert every delivery of a contract stream.

    A delivery that is repeated after a crash finds its ``external_id``s stored and
    asks the scorer nothing.
    """

    def load(delivery: DataFrame, _: int) -> None:
        upsert_run(delivery, scorer, table)

    writer = raw.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    # A stream keeps the settings it starts with: shuffled deliveries go when they are loaded.
    with drop_shuffles(raw.sparkSession):
        return writer.trigger(availableNow=True).start()


def once_per_post(raw: DataFrame, repeats: str) -> DataFrame:
    """A contract stream without the posts that were delivered before, unchanged, within ``repeats``.

    Known posts are 32 bytes each in Spark's state store, which forgets them by the
    time of their arrival: no post is late, however old it is. Changed posts and
    posts without an id pass, for the upsert to decide on. The clock must not be set
    back by more than ``repeats``.
    """
    raw.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    same = F.unhex(F.sha2(F.to_json(F.struct(*S.RAW_CONTRACT.names)), 256))
    key = F.coalesce(F.when(F.col("external_id").isNotNull(), same), F.uuid().cast("binary"))
    arrived = raw.withColumns({"_post": key, "_arrived": F.current_timestamp()}).withWatermark("_arrived", repeats)
    return arrived.dropDuplicatesWithinWatermark(["_post"]).drop("_post", "_arrived")


def stream_posts(
    feeds: DataFrame, submissions: DataFrame, scorer: Scorer, table: str, checkpoint: str, repeats: str = "3 days"
) -> StreamingQuery:
    """From landed Atom documents (``xml``) and submission records to the labelled, scored table.

    A feed shows a post again and again until newer ones push it out; what the state
    has seen is neither cleaned nor compared with the table. What it has forgotten,
    and a delivery repeated after a crash, finds its ``external_id``s stored.
    """
    posts = union_sources(parse_atom_feed(feeds), normalize_submissions(submissions))
    return stream_ingest(once_per_post(posts, repeats), scorer, table, checkpoint)
