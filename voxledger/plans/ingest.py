"""From landed posts to the labelled, scored feedback table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.text import clean_text
from voxledger.functions.timeparse import parse_iso
from voxledger.operators import enrichment as E
from voxledger.operators.priority import score
from voxledger.session import materialize, scratch, settings, settle
from voxledger.sources import contract as C
from voxledger.sources.feedback_table import load_append, load_overwrite, new_rows, to_feedback
from voxledger.sources.posts import newer_than, newest_mark
from voxledger.sources.watermark import read_mark, save_mark

POSITIVE = (1 << 63) - 1


def with_ids(raw: DataFrame) -> DataFrame:
    """Contract rows with an ``id``: a hash of the row's values, the same on every delivery and retry."""
    if "id" in raw.columns:
        return raw
    values = [F.coalesce(F.col(name), F.lit("")) for name in S.RAW_CONTRACT.names]
    return raw.withColumn("id", F.xxhash64(*values).bitwiseAND(F.lit(POSITIVE)))


def clean_rows(raw: DataFrame) -> DataFrame:
    """Contract rows with an id, cleaned text and a UTC timestamp."""
    created = parse_iso(F.col("created_at")).cast("timestamp_ntz")
    return with_ids(raw).withColumn("clean_text", clean_text(F.col("raw_text"))).withColumn("created_at", created)


def label_rows(cleaned: DataFrame, scorer: E.Scorer, batch_size: int = S.BATCH_SIZE) -> DataFrame:
    """Batch, prompt, score and apply. Answers are written once, so no prompt is paid for twice."""
    numbered = E.keep_batches(E.with_item_number(E.micro_batches(cleaned, batch_size)))
    answers = scorer(E.build_batch_prompts(numbered))
    answers = answers.select(*(c for c in E.BATCH if c in answers.columns), "response")
    labelled = E.apply_batch_responses(numbered, materialize(answers, "answers"))
    return labelled.drop(*E.BATCH, "pos", "item")


def _labelled(spark: SparkSession, cleaned: Callable[[], DataFrame | None], scorer: E.Scorer, batch_size: int) -> DataFrame | None:
    """What :func:`label_rows` makes of the rows, written once; only the result stays. None where there are no rows.

    Rows lie by chunk and answers are far fewer, so the answers come to the rows: that takes
    joining by chunk and batch what is placed by chunk alone.
    """

    def label() -> DataFrame | None:
        rows = cleaned()
        return None if rows is None else label_rows(rows, scorer, batch_size)

    with settings(spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return settle(spark, label, "labelled", S.TEXTS)


def ingest_run(
    raw: DataFrame, scorer: E.Scorer, table: str, append: bool = False, batch_size: int = S.BATCH_SIZE
) -> bool:
    """Label and score one delivery and load it; False when there was nothing to load."""
    if raw.isEmpty():
        return False
    with scratch(raw.sparkSession):
        labelled = _labelled(raw.sparkSession, lambda: clean_rows(raw), scorer, batch_size)
        (load_append if append else load_overwrite)(score(labelled), table)
    return True


def upsert_run(raw: DataFrame, scorer: E.Scorer, table: str, batch_size: int = S.BATCH_SIZE) -> bool:
    """Label, score and insert the rows whose ``external_id`` is not stored; no others reach the scorer."""
    spark = raw.sparkSession

    def fresh() -> DataFrame | None:
        rows = materialize(new_rows(clean_rows(raw), spark.table(table)), "fresh", S.TEXTS)
        return None if rows.isEmpty() else rows

    with scratch(spark):
        labelled = _labelled(spark, fresh, scorer, batch_size)
        if labelled is None:
            return False
        # Another job may have stored some of them meanwhile.
        load_append(new_rows(to_feedback(score(labelled)), spark.table(table)), table)
    spark.catalog.refreshTable(table)
    return True


Tier = Callable[[float | None], DataFrame]


def collect_posts(
    tiers: Sequence[Tier], channels: str | Sequence[str], limit: int, since: float | None = None, authoritative: bool = False
) -> DataFrame:
    """Posts of the named channels newer than the mark, from the first tier that has any.

    A tier reads posts newer than a mark as contract rows with ``posted_at`` and
    ``channel``. Each channel gives at most :func:`channel_cap` posts, the newest.
    An authoritative first tier is the answer even when it has none, and gives at
    most :func:`total_cap` posts in all.
    """
    named = C.parse_channels(channels)

    def read(tier: Tier) -> DataFrame:
        return newer_than(tier(since), since).filter(F.col("channel").isin(*named))

    if authoritative:
        return read(tiers[0]).orderBy(F.desc("posted_at"), "external_id").limit(C.total_cap(limit))
    cap = C.channel_cap(limit, len(named))
    # A tier is probed for a single row, before any of its posts are ranked.
    reads = [read(tier) for tier in tiers]
    chosen = next((rows for rows in reads if not rows.isEmpty()), reads[-1])
    return C.per_source_cap(chosen, cap, "channel", "posted_at", "external_id")


def fetch_run(
    spark: SparkSession,
    tiers: Sequence[Tier],
    scorer: E.Scorer,
    table: str,
    mark_path: str,
    channels: str | Sequence[str] = "",
    limit: int = 25,
    authoritative: bool = False,
) -> bool:
    """Collect what is newer than the saved mark, upsert it, and only then move the mark.

    A job that dies in between is repeated from the old mark; the upsert then finds
    its rows stored.
    """
    since = read_mark(spark, mark_path)
    posts = materialize(collect_posts(tiers, channels, limit, since, authoritative), "posts")
    upsert_run(C.to_contract(posts), scorer, table)
    save_mark(newest_mark(posts, since), mark_path)
    return not posts.isEmpty()
