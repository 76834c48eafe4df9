"""Rounding and time arithmetic with one definition everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change to one place; null when there is nothing to compare with."""
    change = (current - previous) / F.nullif(previous.cast("double"), F.lit(0.0)) * 100
    return half_even(change, 1)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session time zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def hours_before_newest(df: DataFrame, hours: int, ts: str = "created_at") -> Column:
    """Start of the window that ends at the newest row, as a one-value subquery.

    The subtraction sits inside the subquery, so the comparison with a plain
    column still reaches the Parquet scan as a pushed filter.
    """
    start = F.max(ts) - F.make_dt_interval(hours=F.lit(int(hours)))
    return df.select(start.alias("window_start")).scalar()


def row_hash(df: DataFrame) -> Column:
    """A hash of the row, for rows that no key tells apart."""
    hashable = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    return F.xxhash64(*hashable)
