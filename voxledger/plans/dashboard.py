"""Metadata, KPI cards and charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions import display as D
from voxledger.operators import metrics as M
from voxledger.operators.filters import filter_recent

# The windows offered and the captions of the cards.
TIME_WINDOWS = (("All Time", 720), ("Last 7 Days", 168), ("Last 24 Hours", 24))
DEFAULT_HOURS = 720
SUBTEXTS = {
    "total_feedback": "vs previous period",
    "bugs_reported": "spike",
    "negative_rate": "vs baseline",
    "avg_urgency": "/ 5 vs baseline",
}


def metadata(df: DataFrame) -> DataFrame:
    """Filter choices, time windows and the row count as (kind, label, value)."""
    null = F.lit(None).cast("bigint")
    facets = M.facet_values(df).select(F.col("facet").alias("kind"), F.col("value").alias("label"), null.alias("value"))
    total = df.agg(F.count(F.lit(1)).alias("n"))
    fixed = [F.struct(F.lit("sentiment").alias("kind"), F.lit(s).alias("label"), null.alias("value")) for s in S.SENTIMENTS]
    fixed += [
        F.struct(F.lit("time_window").alias("kind"), F.lit(label).alias("label"), F.lit(h).cast("bigint").alias("value"))
        for label, h in TIME_WINDOWS
    ]
    counted = F.struct(F.lit("total_records").alias("kind"), F.lit("").alias("label"), F.col("n").alias("value"))
    return facets.unionByName(total.select(F.inline(F.array(*fixed, counted))))


def kpi_cards(df: DataFrame, hours: int = DEFAULT_HOURS) -> DataFrame:
    captions = F.create_map(*[F.lit(part) for pair in SUBTEXTS.items() for part in pair])
    cards = M.kpis(df, hours)
    return cards.withColumn("subtext", F.try_element_at(captions, F.col("metric"))).withColumn(
        "delta_text", D.delta_text(F.col("delta_pct"))
    )


def volume_timeline(df: DataFrame, hours: int = DEFAULT_HOURS) -> DataFrame:
    hourly = M.with_volume_baseline(M.hourly_volume(df, hours))
    hour = F.col("hour")
    return hourly.select(
        "hour", D.clock_text(hour).alias("time"), D.iso_text(hour).alias("iso_time"), "count", "baseline"
    )


def volume_peak(df: DataFrame, hours: int = DEFAULT_HOURS, min_peak: int = 3) -> DataFrame:
    return M.peak_annotation(M.hourly_volume(df, hours), min_peak)


def sentiment_chart(df: DataFrame, hours: int = DEFAULT_HOURS) -> DataFrame:
    return M.sentiment_share(M.sentiment_distribution(filter_recent(df, hours)))


def source_chart(df: DataFrame, hours: int = DEFAULT_HOURS) -> DataFrame:
    counted = M.share_of_max(M.source_breakdown(filter_recent(df, hours)))
    return counted.select(
        F.col("source").alias("source_key"),
        D.source_label(F.col("source"), "chart").alias("source"),
        "count",
        "share_pct",
    )


def charts(df: DataFrame, hours: int = DEFAULT_HOURS) -> DataFrame:
    """All four charts in one long frame: (chart, label, count, value)."""

    def part(frame: DataFrame, chart: str, label: str, count: str, value: str) -> DataFrame:
        measure: Column = F.col(value).cast("double")
        return frame.select(
            F.lit(chart).alias("chart"), F.col(label).alias("label"), F.col(count).alias("count"), measure.alias("value")
        )

    return reduce(
        DataFrame.unionByName,
        [
            part(volume_timeline(df, hours), "volume", "iso_time", "count", "baseline"),
            part(volume_peak(df, hours), "peak", "label", "peak_count", "pct_above_baseline"),
            part(sentiment_chart(df, hours), "sentiment", "sentiment", "count", "percentage"),
            part(source_chart(df, hours), "source", "source", "count", "share_pct"),
        ],
    )
