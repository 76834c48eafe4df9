"""Hourly volume as a stream: running counts per event-time hour, and the rows that came too late for theirs.

State holds one count per open hour; a timer at the watermark closes it. A row of a
closed hour changes no count and is counted as late, in the same output, so that the
number outlives the process: what was delivered is what is counted plus what was late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from voxledger.functions.numeric import from_micros, micros
from voxledger.session import STATE_STORE, folders, remove, rename, scratch_path, ship_by_value

ship_by_value(__name__)

HOUR_US = 3_600_000_000
COUNT_TYPE = "hour timestamp_ntz, count bigint, late bigint"
CHANGE_TYPE = "hour_us bigint, count bigint, late bigint"
DELIVERY, UPTO = "delivery=", "upto="


def count_hours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows per hour within each Arrow batch, so that a busy hour is a few rows in the shuffle."""
    for frame in frames:
        hours = frame["us"] // HOUR_US * HOUR_US
        yield hours.value_counts().rename_axis("hour_us").reset_index(name="n")


class HourProcessor(StatefulProcessor):
    """Counts the rows of an hour until the watermark has passed its end."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hour, n = int(key[0]), sum(int(frame["n"].sum()) for frame in rows)
        end_ms, passed = (hour + HOUR_US) // 1000, timerValues.getCurrentWatermarkInMs()
        if 0 < passed and end_ms <= passed:
            yield pd.DataFrame({"hour_us": [hour], "count": pd.array([None], dtype="Int64"), "late": [n]})
            return
        before = self.held.get()
        total = n + (before[0] if before else 0)
        self.held.update((total,))
        self.handle.registerTimer(end_ms)
        yield pd.DataFrame({"hour_us": [hour], "count": [total], "late": [0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()


def stream_hourly_volume(rows: DataFrame, out: str, checkpoint: str, delay: str = "2 hours") -> StreamingQuery:
    """Write every changed hour of each micro-batch under ``out``.

    Update mode: an hour is visible at once instead of after the watermark.
    A repeated micro-batch overwrites its own folder. Rows without a time belong to no hour.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = rows.filter(F.col("created_at").isNotNull())
    timed = timed.select(F.col("created_at").cast("timestamp").alias("at"), micros(F.col("created_at")).alias("us"))
    # The watermark's column stays behind, so late rows reach the processor and can be counted.
    hours = timed.withWatermark("at", delay).select("us").mapInPandas(count_hours, "hour_us bigint, n bigint")
    counts = hours.groupBy("hour_us").transformWithStateInPandas(HourProcessor(), CHANGE_TYPE, "update", "EventTime")

    def save(changed: DataFrame, delivery: int) -> None:
        hours = changed.select(from_micros(F.col("hour_us")).alias("hour"), "count", "late")
        hours.write.mode("overwrite").parquet(f"{out}/{DELIVERY}{delivery}")

    writer = counts.writeStream.outputMode("update").foreachBatch(save)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _saved(spark: SparkSession, out: str) -> tuple[DataFrame, int, list[str]]:
    """All changes since the last compaction and its result, with ``delivery``; the last delivery, and the folders read."""
    names = folders(spark, out)
    upto = max((int(n.removeprefix(UPTO)) for n in names if n.startswith(UPTO)), default=-1)
    numbers = sorted(int(n.removeprefix(DELIVERY)) for n in names if n.startswith(DELIVERY))
    read = [f"{UPTO}{upto}"] * (upto >= 0) + [f"{DELIVERY}{n}" for n in numbers if n > upto]
    if not read:
        return spark.createDataFrame([], COUNT_TYPE + ", delivery bigint"), -1, []
    # Both kinds of folder are named by a number.
    number = F.regexp_extract(F.col("_metadata.file_path"), f"/(?:{DELIVERY}|{UPTO})([0-9]+)/[^/]*$", 1).cast("bigint")
    changes = spark.read.schema(COUNT_TYPE).parquet(*(f"{out}/{name}" for name in read))
    return changes.select("*", number.alias("delivery")), max([upto, *numbers]), read


def _merged(changes: DataFrame) -> DataFrame:
    latest = F.max_by("count", F.when(F.col("count").isNotNull(), F.col("delivery")))
    return changes.groupBy("hour").agg(latest.alias("count"), F.sum("late").alias("late"))


def read_hourly_volume(spark: SparkSession, out: str) -> DataFrame:
    """The latest count of every hour."""
    return _merged(_saved(spark, out)[0]).filter("count IS NOT NULL").select("hour", "count")


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows per hour that came after it was closed and that no count holds, over all runs."""
    return _merged(_saved(spark, out)[0]).filter("late > 0").select("hour", "late")


def compact_hourly_volume(spark: SparkSession, out: str) -> None:
    """Merge all deliveries so far into one folder, by one rename; readers never see both it and what it replaces."""
    changes, last, read = _saved(spark, out)
    if len(read) < 2:
        return
    aside = f"{out}/_{scratch_path(spark, 'compact').rpartition('/')[2]}"
    _merged(changes).write.parquet(aside)
    if rename(spark, aside, f"{out}/{UPTO}{last}"):
        for name in read:
            remove(spark, f"{out}/{name}")
