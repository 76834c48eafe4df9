"""Spike windows: bursts of incident reports, exact and parallel.

The rule is a greedy scan per category: at a row, count the rows of the next
``w`` minutes (both ends included); with ``threshold`` or more, that is a
window and the scan continues behind it, otherwise it moves to the next row.

A scan per category would run as two tasks, so the work is cut by time:

* Equal timestamps are counted first, with partial aggregation, so a burst in
  a single instant is one row.
* Rows are compared inside cells of ``w / 3600``. A cell holds at most
  ``threshold`` rows per microsecond, whatever the size of the burst, and the
  few rows it needs from later cells are handed over explicitly.
* Instants at which no window can start are dropped before any are gathered.
* The chain of windows is followed per block of time for every position at
  which it could enter the block, the per-block results are composed, and
  once the entry of each block is known all blocks are replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.numeric import from_micros, micros
from voxledger.operators.filters import filter_incident_categories
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

CELLS_PER_WINDOW = 3600
SLOTS_PER_WINDOW = 12
WINDOWS_PER_BLOCK = 24
BLOCKS_PER_SPAN = 30
BEFORE_ALL = -(2**62)

MAP_TYPE = "category string, block bigint, entry bigint, leave bigint"
ENTRY_TYPE = "category string, block bigint, reached bigint"
RANGE_TYPE = "category string, low bigint, high bigint"
START_TYPE = "category string, start_us bigint"


def window_micros(window_minutes: int) -> int:
    return int(window_minutes) * 60_000_000


def time_slot(us: Column, width: int) -> Column:
    """Number of the slot of ``width`` microseconds; exact, also before 1970."""
    return ((us - F.pmod(us, F.lit(width).cast("bigint"))) / F.lit(width)).cast("bigint")


def incident_times(df: DataFrame) -> DataFrame:
    """Rows per incident category and instant."""
    rows = filter_incident_categories(df).filter(F.col("created_at").isNotNull())
    return rows.groupBy("category", micros(F.col("created_at")).alias("us")).agg(F.count(F.lit(1)).alias("n"))


def qualifying_times(times: DataFrame, threshold: int, window_us: int) -> DataFrame:
    """Instants with at least ``threshold`` rows in the window that they open."""
    if threshold <= 1:
        return times.select("category", "us")
    cell_us = max(1, window_us // CELLS_PER_WINDOW)
    ahead = threshold - 1
    # More than ``threshold`` rows at one instant cannot change any comparison below.
    copies = F.array_repeat("us", F.least(F.col("n"), F.lit(threshold)).cast("int"))
    rows = times.select("category", time_slot(F.col("us"), cell_us).alias("cell"), F.explode(copies).alias("us"))

    in_cell = Window.partitionBy("category", "cell").orderBy("us")
    heads = rows.withColumn("r", F.row_number().over(in_cell)).filter(F.col("r") <= ahead).drop("r")

    # The same hand-over one level up: a slot of one window length sees the first heads of the next.
    in_slot = Window.partitionBy("category", "slot").orderBy("us")
    placed = heads.withColumn("slot", time_slot(F.col("us"), window_us)).withColumn("r", F.row_number().over(in_slot))
    own = F.struct(F.col("slot").alias("slot"), F.lit(True).alias("own"))
    lent = F.when(F.col("r") <= ahead, F.struct((F.col("slot") - 1).alias("slot"), F.lit(False).alias("own")))
    following = (
        placed.select("category", "cell", "us", F.inline(F.array_compact(F.array(own, lent))))
        .withColumn("next_cell", F.lead("cell").over(in_slot))
        .withColumn("later", F.collect_list("us").over(in_slot.rowsBetween(1, ahead)))
        .filter(F.col("own") & (F.col("next_cell") > F.col("cell")))
    )
    borrowed = following.select("category", "cell", F.explode("later").alias("us"), F.lit(False).alias("own"))

    return (
        rows.withColumn("own", F.lit(True))
        .unionByName(borrowed)
        .withColumn("reach", F.lead("us", ahead).over(in_cell))
        .withColumn("previous", F.lag("us").over(in_cell))
        .filter(F.col("own") & (F.col("reach") <= F.col("us") + window_us))
        .filter(F.col("previous").isNull() | (F.col("previous") < F.col("us")))
        .select("category", "us")
    )


def reachable_times(qualifying: DataFrame, window_us: int) -> DataFrame:
    """Drop instants that no chain can stop at; keeps the ``cell`` they lie in.

    A chain stops at ``q`` only if some window ends after the qualifying
    instant before ``q`` and before ``q``. Instants that open a cell are kept
    without asking. What is left in a burst is no more than the instants one
    window earlier, plus one per cell.
    """
    cell_us = max(1, window_us // CELLS_PER_WINDOW)
    stop = F.struct(F.col("us").alias("us"), F.lit(0).alias("is_end"))
    end = F.struct((F.col("us") + window_us).alias("us"), F.lit(1).alias("is_end"))
    both = qualifying.select("category", F.inline(F.array(stop, end)))
    both = both.withColumn("cell", time_slot(F.col("us"), cell_us))
    order = Window.partitionBy("category", "cell").orderBy("us", "is_end")
    return (
        both.withColumn("after_end", F.lag("is_end").over(order))
        .filter((F.col("is_end") == 0) & (F.coalesce("after_end", F.lit(1)) == 1))
        .select("category", "cell", "us")
    )


def corridor(times: DataFrame, window_us: int) -> DataFrame:
    """Stretches of time that contain every window start, as disjoint (``low``, ``high``).

    Each slot of a twelfth of the window is summarised by its first and last
    instant and its widest gap. Following the chain on the summaries alone
    gives bounds for every start: one step adds at most one gap of
    uncertainty, and any pause longer than the uncertainty removes it. Where
    instants are dense the gaps are small and few instants remain; where they
    are sparse there is little to drop. The summaries per category are as many
    as the slots in the time span, however many rows there are.
    """
    in_cell = Window.partitionBy("category", "cell").orderBy("us")
    cells = (
        times.withColumn("gap", F.col("us") - F.lag("us").over(in_cell))
        .groupBy("category", "cell")
        .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.max("gap").alias("gap"))
        .withColumn("slot", time_slot(F.col("first"), max(1, window_us // SLOTS_PER_WINDOW)))
    )
    in_slot = Window.partitionBy("category", "slot").orderBy("cell")
    slots = (
        cells.withColumn("between", F.col("first") - F.lag("last").over(in_slot))
        .groupBy("category", "slot")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.coalesce(F.greatest(F.max("gap"), F.max("between")), F.lit(0).cast("bigint")).alias("gap"),
        )
    )
    return slots.groupBy("category").applyInPandas(_track(window_us), RANGE_TYPE)


def within(times: DataFrame, ranges: DataFrame, window_us: int) -> DataFrame:
    """Instants inside the (disjoint) ranges, matched slot by slot."""
    slot_us = max(1, window_us // SLOTS_PER_WINDOW)
    slots = F.sequence(time_slot(F.col("low"), slot_us), time_slot(F.col("high"), slot_us))
    pieces = ranges.select("category", "low", "high", F.explode(slots).alias("slot"))
    slotted = times.select("category", "us", time_slot(F.col("us"), slot_us).alias("slot"))
    joined = slotted.join(pieces, ["category", "slot"])
    return joined.filter((F.col("us") >= F.col("low")) & (F.col("us") <= F.col("high"))).select("category", "us")


def _track(window_us: int):
    def run(key: tuple, slots: pd.DataFrame) -> pd.DataFrame:
        slots = slots.sort_values("slot")
        first, last, gap = (slots[name].to_numpy() for name in ("first", "last", "gap"))
        ranges: list[list[int]] = []
        low = high = BEFORE_ALL
        while (a := int(np.searchsorted(last, low, side="right"))) < len(last):
            b = int(np.searchsorted(last, high, side="right"))
            earliest = max(low + 1, int(first[a]))
            if b == len(last):
                latest = int(last[-1])
            elif high < first[b]:
                latest = int(first[b])
            else:
                latest = int(min(high + gap[b], last[b]))
            if ranges and earliest <= ranges[-1][1] + 1:
                ranges[-1][1] = max(ranges[-1][1], latest)
            else:
                ranges.append([earliest, latest])
            low, high = earliest + window_us, latest + window_us
        bounds = np.array(ranges, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"category": key[0], "low": bounds[:, 0], "high": bounds[:, 1]})

    return run


def _enter(entries: np.ndarray, leaves: np.ndarray, reached: np.ndarray, window_us: int) -> np.ndarray:
    """Carry positions through one block map; untouched where the block has no later start."""
    at = np.searchsorted(entries, reached, side="right")
    hit = at < len(entries)
    moved = reached.copy()
    moved[hit] = leaves[at[hit]] + window_us
    return moved


def chain_start_count(times: np.ndarray, block_start: int, window_us: int) -> int:
    """How many leading times a chain can enter the block at: those of its first window, and one more."""
    return min(len(times), int(np.searchsorted(times, block_start + window_us, side="left")) + 1)


def _as_map(category: str, block: int, entries: np.ndarray, leaves: np.ndarray) -> pd.DataFrame:
    """Map rows. Leading times with the same outcome need only their last one."""
    ends_run = np.append(leaves[1:] != leaves[:-1], True)
    return pd.DataFrame({"category": category, "block": block, "entry": entries[ends_run], "leave": leaves[ends_run]})


def _by_block(maps: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    maps = maps.sort_values(["block", "entry"])
    for block, part in maps.groupby("block", sort=True):
        yield int(block), part["entry"].to_numpy(), part["leave"].to_numpy()


def _block_map(window_us: int, block_us: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        category, block = key
        times = np.sort(rows["us"].to_numpy())
        here = np.arange(len(times))
        following = np.searchsorted(times, times + window_us, side="right")
        last = np.where(following < len(times), following, here)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        count = chain_start_count(times, int(block) * block_us, window_us)
        return _as_map(category, block, times[:count], times[last[:count]])

    return run


def _compose(window_us: int, span_us: int):
    def run(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
        category, span = key
        blocks = list(_by_block(maps))
        entries = np.concatenate([entry for _, entry, _ in blocks])
        entries = entries[: chain_start_count(entries, int(span) * span_us, window_us)]
        reached = entries - 1
        for _, entry, leave in blocks:
            reached = _enter(entry, leave, reached, window_us)
        return _as_map(category, span, entries, reached - window_us)

    return run


def _fold(category: str, maps: pd.DataFrame, reached: int, window_us: int) -> pd.DataFrame:
    at = np.array([reached], dtype=np.int64)
    found: dict[str, list] = {"block": [], "reached": []}
    for block, entry, leave in _by_block(maps):
        found["block"].append(block)
        found["reached"].append(int(at[0]))
        at = _enter(entry, leave, at, window_us)
    return pd.DataFrame({"category": category, **found})


def _fold_all(window_us: int):
    def run(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
        return _fold(key[0], maps, BEFORE_ALL, window_us)

    return run


def _fold_span(window_us: int):
    def run(key: tuple, maps: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return _fold(key[0], maps, int(entry["reached"].iloc[0]), window_us)

    return run


def following_chain(following: np.ndarray, entered: int) -> np.ndarray:
    """Places that chains from the first ``entered`` ones stop at, each place leading to a later one."""
    stops = np.zeros(len(following) + 1, dtype=bool)
    front = np.arange(entered)
    while len(front):
        stops[front] = True
        front = np.unique(following[front])
        front = front[~stops[front] & (front < len(following))]
    return np.flatnonzero(stops[:-1])


def walk_chain(times: np.ndarray, reached: int, window_us: int) -> np.ndarray:
    """Starts behind ``reached`` among sorted qualifying times."""
    starts = []
    at = int(np.searchsorted(times, reached, side="right"))
    while at < len(times):
        starts.append(times[at])
        at = int(np.searchsorted(times, times[at] + window_us, side="right"))
    return np.array(starts, dtype=np.int64)


def _replay(window_us: int):
    def run(key: tuple, rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        starts = walk_chain(np.sort(rows["us"].to_numpy()), int(entry["reached"].iloc[0]), window_us)
        return pd.DataFrame({"category": key[0], "start_us": starts})

    return run


def chain_by_blocks(times: DataFrame, window_us: int) -> DataFrame:
    """Window starts among candidates, block by block."""
    block_us = window_us * WINDOWS_PER_BLOCK
    span_us = block_us * BLOCKS_PER_SPAN
    blocked = times.withColumn("block", time_slot(F.col("us"), block_us))
    maps = blocked.groupBy("category", "block").applyInPandas(_block_map(window_us, block_us), MAP_TYPE)
    spanned = maps.withColumn("span", time_slot(F.col("block"), BLOCKS_PER_SPAN))
    span_maps = spanned.groupBy("category", "span").applyInPandas(_compose(window_us, span_us), MAP_TYPE)
    span_entries = (
        span_maps.groupBy("category")
        .applyInPandas(_fold_all(window_us), ENTRY_TYPE)
        .withColumnRenamed("block", "span")
    )
    block_entries = (
        spanned.groupBy("category", "span")
        .cogroup(span_entries.groupBy("category", "span"))
        .applyInPandas(_fold_span(window_us), ENTRY_TYPE)
    )
    return (
        blocked.groupBy("category", "block")
        .cogroup(block_entries.groupBy("category", "block"))
        .applyInPandas(_replay(window_us), START_TYPE)
    )


def window_starts(times: DataFrame, threshold: int, window_us: int) -> DataFrame:
    """Window starts from counted instants (written, as they are read several times).

    Instants are tested in cells, narrowed to candidates, and the chain is
    followed block by block.
    """
    reachable = reachable_times(qualifying_times(times, threshold, window_us), window_us)
    candidates = materialize(within(reachable, corridor(reachable, window_us), window_us), "candidates")
    return chain_by_blocks(candidates, window_us)


def spike_windows(
    df: DataFrame, threshold: int = S.SPIKE_THRESHOLD, window_minutes: int = S.SPIKE_WINDOW_MINUTES
) -> DataFrame:
    """One row per detected window: ``category``, ``start_us``, ``window_start``."""
    times = materialize(incident_times(df), "times")
    starts = window_starts(times, int(threshold), window_micros(window_minutes))
    return starts.withColumn("window_start", from_micros(F.col("start_us")))
