"""ISO-8601 text to timestamps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted input shape, and the shape that is passed on untouched.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
ISO_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?[+-]\d{2}:\d{2}$"


def try_parse_iso(text: Column) -> Column:
    """Timestamp, or null when the text is not ISO-8601."""
    return F.when(text.rlike(ISO_SHAPE), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parse_iso(text: Column, now: Column | None = None) -> Column:
    """Timestamp; text that does not parse counts as now."""
    return F.coalesce(try_parse_iso(text), F.current_timestamp() if now is None else now)


def iso_utc(ts: Column) -> Column:
    """ISO text in UTC; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.concat(whole, F.when(fraction != ".000000", fraction).otherwise(""), F.lit("+00:00"))


def iso_or_now(text: Column, ts: Column) -> Column:
    """Keep well-formed input as it came, write everything else in UTC."""
    return F.when(text.rlike(ISO_CANONICAL), text).otherwise(iso_utc(ts))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch with the microseconds as fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_micros(F.rint(seconds * F.lit(1e6)).cast("bigint"))
