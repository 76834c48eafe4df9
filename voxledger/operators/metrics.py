"""Dashboard aggregates. Every one starts with a partial aggregation on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.numeric import half_even, hours_before_newest, pct_change
from voxledger.operators.filters import filter_recent

KPI_NAMES = ("total_feedback", "bugs_reported", "negative_rate", "avg_urgency")


def split_windows(df: DataFrame, hours: int = 24) -> DataFrame:
    """Mark each row of the last two windows as ``current`` or ``previous``."""
    start = hours_before_newest(df, hours)
    earliest = hours_before_newest(df, 2 * hours)
    period = F.when(F.col("created_at") >= start, "current").otherwise("previous")
    return df.filter(F.col("created_at") >= earliest).withColumn("period", period)


def kpis(df: DataFrame, hours: int = 24) -> DataFrame:
    """Four figures of the current window and their change, one row per metric."""
    marked = split_windows(df, hours)

    def measures(period: str) -> list[Column]:
        inside = F.col("period") == period
        rows = F.count_if(inside)
        negative = F.count_if(inside & (F.col("sentiment") == "Negative"))
        rate = half_even(negative / F.nullif(rows, F.lit(0)) * 100, 1)
        urgency = half_even(F.avg(F.when(inside, F.col("urgency_score"))), 1)
        return [
            rows.cast("double").alias(f"total_feedback_{period}"),
            F.count_if(inside & (F.col("category") == "Bug")).cast("double").alias(f"bugs_reported_{period}"),
            F.coalesce(rate, F.lit(0.0)).alias(f"negative_rate_{period}"),
            F.coalesce(urgency, F.lit(0.0)).alias(f"avg_urgency_{period}"),
        ]

    wide = marked.agg(*measures("current"), *measures("previous"))
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(name).alias("metric"),
            F.col(f"{name}_current").alias("value"),
            pct_change(F.col(f"{name}_current"), F.col(f"{name}_previous")).alias("delta_pct"),
        )
        for i, name in enumerate(KPI_NAMES)
    ]
    return wide.select(F.inline(F.array(*rows)))


def hourly_volume(df: DataFrame, hours: int = 24) -> DataFrame:
    """Rows per hour of the last ``hours`` hours, with zeros in between.

    At most ``hours + 1`` rows leave the partial aggregation per task. The
    zero rows come from the first and last hour of the same aggregate and are
    added up with the counts, so no join is needed.
    """
    counts = (
        filter_recent(df, hours)
        .groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    step = F.make_dt_interval(hours=F.lit(1))
    zeros = counts.agg(F.min("hour").alias("first"), F.max("hour").alias("last")).filter("first IS NOT NULL")
    zeros = zeros.select(F.explode(F.sequence("first", "last", step)).alias("hour"), F.lit(0).cast("bigint").alias("count"))
    return counts.unionByName(zeros).groupBy("hour").agg(F.sum("count").alias("count"))


def with_volume_baseline(volume: DataFrame) -> DataFrame:
    """Mean of the hourly counts, to one place, on every hour."""
    return volume.withColumn("baseline", half_even(volume.agg(F.avg("count")).scalar(), 1))


def peak_annotation(volume: DataFrame, min_peak: int = 3) -> DataFrame:
    """The first largest hour, kept only when it stands out; one row or none."""
    summary = volume.agg(
        F.avg("count").alias("baseline"),
        F.max(F.struct(F.col("count"), (-F.unix_seconds(F.col("hour").cast("timestamp"))).alias("neg"))).alias("peak"),
    ).select(
        "baseline",
        F.col("peak.count").alias("peak_count"),
        F.timestamp_seconds(-F.col("peak.neg")).cast("timestamp_ntz").alias("peak_hour"),
    )
    pct = F.rint((F.col("peak_count") - F.col("baseline")) / F.col("baseline") * 100).cast("bigint")
    clock = F.date_format("peak_hour", "HH:mm")
    stands_out = (
        (F.col("baseline") > 0)
        & (F.col("peak_count") >= min_peak)
        & (F.col("peak_count") > F.col("baseline") * 1.5)
    )
    return summary.filter(stands_out).select(
        clock.alias("peak_time"),
        "peak_hour",
        "peak_count",
        pct.alias("pct_above_baseline"),
        F.concat(F.lit("Spike Detected: ~"), clock, F.lit(" (+"), pct.cast("string"), F.lit("% above norm)")).alias("label"),
    )


def sentiment_distribution(df: DataFrame) -> DataFrame:
    """Rows per sentiment in fixed order with zeros; other values are not counted."""
    counted = df.agg(*[F.count_if(F.col("sentiment") == name).alias(f"n{i}") for i, name in enumerate(S.SENTIMENTS)])
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(name).alias("sentiment"), F.col(f"n{i}").alias("count"))
        for i, name in enumerate(S.SENTIMENTS)
    ]
    return counted.select(F.inline(F.array(*rows)))


def sentiment_share(distribution: DataFrame) -> DataFrame:
    """Percent of the total, to one place."""
    total = distribution.agg(F.sum("count")).scalar()
    share = half_even(F.col("count") / F.nullif(total, F.lit(0)) * 100, 1)
    return distribution.withColumn("percentage", F.coalesce(share, F.lit(0.0)))


def source_breakdown(df: DataFrame) -> DataFrame:
    """Rows per source, most first."""
    counts = df.filter(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "source")


def share_of_max(breakdown: DataFrame) -> DataFrame:
    """Each count relative to the largest one, in percent."""
    largest = F.greatest(breakdown.agg(F.max("count")).scalar(), F.lit(1).cast("bigint"))
    return breakdown.withColumn("share_pct", F.col("count") / largest * 100)


def facet_values(df: DataFrame) -> DataFrame:
    """Distinct categories and sources, sorted, from one scan."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("facet"), F.col(name).alias("value")) for name in ("category", "source")]
    )
    return df.select(F.inline(pairs)).filter("value IS NOT NULL").distinct().orderBy("facet", "value")


def baseline_rate(df: DataFrame, window_minutes: int = S.SPIKE_WINDOW_MINUTES) -> DataFrame:
    """Expected rows per window of each incident category, one row each.

    The span covers all rows of all categories.
    """
    created = F.unix_micros(F.col("created_at").cast("timestamp"))
    totals = df.agg(
        ((F.max(created) - F.min(created)) / F.lit(1e6) / F.lit(60)).alias("span_minutes"),
        *[F.count_if(F.col("category") == name).alias(f"n{i}") for i, name in enumerate(S.INCIDENT_CATEGORIES)],
    )
    rate = [
        F.when(F.col("span_minutes") > 0, F.col(f"n{i}") / F.col("span_minutes") * window_minutes).otherwise(F.lit(0.0))
        for i in range(len(S.INCIDENT_CATEGORIES))
    ]
    rows = [
        F.struct(
            F.lit(name).alias("category"),
            F.col(f"n{i}").alias("category_total"),
            rate[i].alias("baseline"),
        )
        for i, name in enumerate(S.INCIDENT_CATEGORIES)
    ]
    return totals.select(F.inline(F.array(*rows))).filter("category_total > 0")
