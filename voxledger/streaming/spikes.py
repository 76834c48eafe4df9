"""Spike windows on a stream, equal to the batch result on timely rows.

Two stateful operators hold everything in Spark's state store. The first is keyed by
category and block of time: it lists the instants of its block and those of the next
window, and a timer at the point where the watermark has passed both closes the block.
A closed block gives the instants at which a chain of windows could stop in it. The
second operator keeps one number per category, how far its windows reach, and follows
the chain through the blocks as they close. Windows go to a file sink, once each;
restarts continue from the checkpoint.

Rows older than the watermark change nothing. They are counted, and the counts go to
the same sink. The watermark's column does not reach the operators, so that Spark
leaves it to them to tell such rows from timely ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from voxledger import schema as S
from voxledger.functions.numeric import from_micros, micros
from voxledger.operators.filters import filter_incident_categories
from voxledger.operators.spikes import chain_start_count, following_chain, time_slot, walk_chain, window_micros, window_starts
from voxledger.session import STATE_STORE, exists, materialize, ship_by_value

ship_by_value(__name__)

WINDOWS_PER_BLOCK = 24
INSTANT_TYPE = "category string, us bigint, n bigint"
# What one delivery adds to a block: its own instants, and those that open the next block.
LISTED_TYPE = "us array<bigint>, n array<bigint>, next_us array<bigint>, next_n array<bigint>"
CLOSED_TYPE = "category string, block bigint, times array<bigint>, late bigint"
WINDOW_TYPE = "category string, start_us bigint, late bigint"


def count_instants(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows per category and instant within each Arrow batch, so a burst in one instant is one row before the shuffle."""
    for frame in frames:
        yield frame.groupby(["category", "us"], as_index=False).size().rename(columns={"size": "n"})


def merged(us: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct instants and their rows."""
    instants, place = np.unique(us, return_inverse=True)
    return instants, np.bincount(place, weights=n, minlength=len(instants)).astype(np.int64)


class BlockProcessor(StatefulProcessor):
    """Lists the instants of a block of time until no timely row can add to them."""

    def __init__(self, threshold: int, window_us: int, block_us: int) -> None:
        self.threshold, self.window_us, self.block_us = threshold, window_us, block_us

    def init(self, handle) -> None:
        self.handle = handle
        self.listed = handle.getListState("listed", LISTED_TYPE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        block = int(key[1])
        frame = pd.concat(list(rows), ignore_index=True)
        us, n, own = (frame[c].to_numpy() for c in ("us", "n", "own"))
        passed = timerValues.getCurrentWatermarkInMs()
        # Before the first delivery is over there is no watermark yet.
        timely = us >= passed * 1000 if passed > 0 else np.ones(len(us), dtype=bool)
        if timely.any():
            mine, lent = merged(us[timely & own], n[timely & own]), merged(us[timely & ~own], n[timely & ~own])
            self.listed.appendValue(tuple(a.tolist() for a in (*mine, *lent)))
            closes = (block + 1) * self.block_us + self.window_us
            self.handle.registerTimer(-(-closes // 1000))
        late = int(n[~timely & own].sum())
        if late:
            yield pd.DataFrame({"category": [key[0]], "block": [block], "times": [None], "late": [late]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        us, n, next_us, next_n = (np.concatenate([np.asarray(a, dtype=np.int64) for a in part]) for part in zip(*self.listed.get()))
        self.listed.clear()
        times = self.stops(int(key[1]), *merged(us, n), *merged(next_us, next_n))
        if len(times):
            yield pd.DataFrame({"category": [key[0]], "block": [int(key[1])], "times": [times.tolist()], "late": [0]})

    def stops(self, block: int, us, n, next_us, next_n) -> np.ndarray:
        """Instants of a block that open a full window and that a chain through the block can stop at."""
        all_us, before = np.concatenate([us, next_us]), np.concatenate([[0], np.cumsum(np.concatenate([n, next_n]))])
        here = np.arange(len(us))
        full = before[np.searchsorted(all_us, us + self.window_us, side="right")] - before[here] >= self.threshold
        times = us[full]
        following = np.searchsorted(times, times + self.window_us, side="right")
        entered = chain_start_count(times, block * self.block_us, self.window_us)
        return times[following_chain(following, entered)]


class ChainProcessor(StatefulProcessor):
    """Follows the windows of a category through its blocks in order."""

    def __init__(self, window_us: int) -> None:
        self.window_us = window_us

    def init(self, handle) -> None:
        self.reached = handle.getValueState("reached", "us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values("block")
        held = self.reached.get()
        reached = held[0] if held else np.iinfo(np.int64).min
        for times in frame["times"]:
            starts = walk_chain(np.asarray(times, dtype=np.int64), reached, self.window_us) if times is not None else ()
            if len(starts):
                reached = int(starts[-1]) + self.window_us
                self.reached.update((reached,))
                yield pd.DataFrame({"category": key[0], "start_us": starts, "late": 0})
        late = int(frame["late"].sum())
        if late:
            yield pd.DataFrame({"category": [key[0]], "start_us": pd.array([None], dtype="Int64"), "late": [late]})


@dataclass(frozen=True)
class SpikeStream:
    """Where the windows of a spike stream go, and its parameters."""

    root: str
    checkpoint: str
    threshold: int = S.SPIKE_THRESHOLD
    window_minutes: int = S.SPIKE_WINDOW_MINUTES
    delay_minutes: int = 120

    @property
    def window_us(self) -> int:
        return window_micros(self.window_minutes)

    def windows(self, rows: DataFrame) -> DataFrame:
        """The stream of closed windows and of counts of late rows."""
        window_us, block_us = self.window_us, WINDOWS_PER_BLOCK * self.window_us
        incidents = filter_incident_categories(rows).filter(F.col("created_at").isNotNull())
        timed = incidents.select("category", micros(F.col("created_at")).alias("us"), F.col("created_at").cast("timestamp").alias("at"))
        instants = timed.withWatermark("at", f"{self.delay_minutes} minutes").select("category", "us").mapInPandas(count_instants, INSTANT_TYPE)
        block, past = time_slot(F.col("us"), block_us), F.pmod(F.col("us"), F.lit(block_us))
        own = F.struct(block.alias("block"), F.lit(True).alias("own"))
        # The first window of a block is also needed to count the last windows of the block before it.
        lent = F.when(past <= window_us, F.struct((block - 1).alias("block"), F.lit(False).alias("own")))
        dealt = instants.select("category", "us", "n", F.inline(F.array_compact(F.array(own, lent))))
        closed = dealt.groupBy("category", "block").transformWithStateInPandas(
            BlockProcessor(int(self.threshold), window_us, block_us), CLOSED_TYPE, "append", "EventTime"
        )
        return closed.groupBy("category").transformWithStateInPandas(ChainProcessor(window_us), WINDOW_TYPE, "append", "None")

    def start(self, rows: DataFrame) -> StreamingQuery:
        """Work off what has arrived; a later start, also after a crash, goes on from the checkpoint."""
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        writer = self.windows(rows).writeStream.format("parquet").option("path", self.root).option("checkpointLocation", self.checkpoint)
        return writer.outputMode("append").trigger(availableNow=True).start()

    def _written(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, f"{self.root}/_spark_metadata"):
            return spark.createDataFrame([], WINDOW_TYPE)
        return spark.read.schema(WINDOW_TYPE).parquet(self.root)

    def closed_windows(self, spark: SparkSession) -> DataFrame:
        """Windows no later row can change."""
        starts = self._written(spark).filter("start_us IS NOT NULL").select("category", "start_us")
        return starts.withColumn("window_start", from_micros(F.col("start_us")))

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows per category that came behind the watermark, since the stream's first start."""
        return self._written(spark).filter("late > 0").groupBy("category").agg(F.sum("late").alias("late"))

    def undecided(self, spark: SparkSession) -> DataFrame:
        """Instants of blocks that are still open, as the state store holds them, behind the windows already closed."""
        known = spark.read.format("state-metadata").load(self.checkpoint)
        number = known.filter(F.col("operatorProperties").contains('"listed"')).agg(F.max("operatorId")).first()[0]
        store = spark.read.format("statestore").option("path", self.checkpoint).option("operatorId", number)
        held = store.option("stateVarName", "listed").load()
        lists = held.select("key.category", F.col("list_element.us").alias("us"), F.col("list_element.n").alias("n"))
        instants = lists.select("category", F.inline(F.arrays_zip("us", "n"))).groupBy("category", "us").agg(F.sum("n").alias("n"))
        reached = self._written(spark).groupBy("category").agg((F.max("start_us") + self.window_us).alias("reached"))
        ahead = instants.join(reached, "category", "left").filter(F.col("reached").isNull() | (F.col("us") > F.col("reached")))
        return ahead.select("category", "us", "n")

    def open_windows(self, spark: SparkSession) -> DataFrame:
        """What the undecided rows amount to if nothing else arrives."""
        times = materialize(self.undecided(spark), "undecided")
        return window_starts(times, int(self.threshold), self.window_us).withColumn("window_start", from_micros(F.col("start_us")))
