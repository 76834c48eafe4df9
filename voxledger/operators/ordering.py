"""Exact positions in a total order, top-n and paging, without a one-task sort."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.functions.numeric import row_hash
from voxledger.session import materialize

# A partition's rows are numbered below this bit by monotonically_increasing_id.
ROW_BITS = 33
# Rows up to the end of a page that may be kept in a heap per task.
HEAP_ROWS = 20_000
# Value ranges counted in one pass when looking for a rank.
BINS = 1024


def with_position(df: DataFrame, id_column: str, order: Sequence[Column] = (), name: str = "position") -> DataFrame:
    """0-based position in the order (``order``, ``id_column``).

    Rows are dealt to ranges of the order and sorted inside them, once, and
    written; a row's position is the number of rows in earlier ranges, of which
    there are as many as tasks, plus its place in its own. Rows without an id come
    last among equals, ordered by a hash of their values, so any number of them
    spreads over ranges.
    """
    keys = [*order, F.asc_nulls_last(id_column), F.when(F.col(id_column).isNull(), row_hash(df)).asc()]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0).cast("bigint")).alias("_start"))
    by_part = starts.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_start"))).alias("starts")).scalar()
    inside = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.select(*df.columns, (F.try_element_at(by_part, part) + inside).alias(name))


def with_rank(scored: DataFrame) -> DataFrame:
    """0-based ``rank`` by priority, ties by id."""
    return with_position(scored, "id", [F.desc_nulls_last("priority_score")], "rank")


def top_n(scored: DataFrame, n: int = 100) -> DataFrame:
    return scored.orderBy(F.desc_nulls_last("priority_score"), "id").limit(n)


def paginate(scored: DataFrame, page: int = 1, limit: int = 25, heap_rows: int | None = None) -> DataFrame:
    """One page of the ranked rows; empty past the end.

    A page near the top is kept in a heap per task. A deep one is cut out by value: the
    rows at its two ends are found by :func:`key_at`, and only rows between them sorted.
    """
    if page < 1 or not 1 <= limit <= 200:
        raise ValueError("page starts at 1 and limit lies between 1 and 200")
    start, order = (page - 1) * limit, [F.desc_nulls_last("priority_score"), F.asc("id")]
    if start + limit <= (HEAP_ROWS if heap_rows is None else heap_rows):
        return scored.orderBy(*order).offset(start).limit(limit)
    keys = materialize(scored.select("priority_score", "id"), "keys")
    total = keys.count()
    if start >= total:
        return scored.limit(0)
    first, last = key_at(keys, start), key_at(keys, min(start + limit, total) - 1)
    score, ident = F.col("priority_score"), F.col("id")
    page_rows = scored.filter(_not_before(score, ident, first) & _not_after(score, ident, last))
    return page_rows.orderBy(*order).offset(first.earlier).limit(limit)


class Key(NamedTuple):
    """Score and id at a rank, and how many rows with the same come before it."""

    score: float | None
    id: int | None
    earlier: int


def _not_before(score: Column, ident: Column, key: Key) -> Column:
    after = F.lit(True) if key.id is None else ident >= key.id
    if key.score is None:
        return score.isNull() & after
    return score.isNull() | (score < key.score) | ((score == key.score) & after)


def _not_after(score: Column, ident: Column, key: Key) -> Column:
    upto = ident.isNull() if key.id is None else ident.isNull() | (ident <= key.id)
    if key.score is None:
        return score.isNotNull() | upto
    return (score > key.score) | ((score == key.score) & upto)


def key_at(keys: DataFrame, rank: int) -> Key:
    """The key of the row at a rank: highest score first, ties by id, without sorting.

    Counts of value ranges are refined around the rank, first of the score, then of the
    id among rows of that score, until one value is left. Each pass returns at most
    ``BINS`` counts; a table of any size takes a few passes over two narrow columns.
    """
    score, rank = _value_at(keys, "priority_score", rank, descending=True)
    same = keys.filter(F.col("priority_score").eqNullSafe(F.lit(score).cast("double")))
    ident, rank = _value_at(same, "id", rank, descending=False)
    return Key(score, ident, rank)


def _value_at(rows: DataFrame, name: str, rank: int, descending: bool) -> tuple[float | int | None, int]:
    """Value of a column at a rank, and the rank among rows of that value. Nulls come last when descending, else first."""
    value = F.col(name)
    found = rows.agg(F.min(value), F.max(value), F.count(value), F.count_if(value.isNull())).first()
    low, high, filled, nulls = found
    if descending and rank >= filled:
        return None, rank - filled
    if not descending:
        if rank < nulls:
            return None, rank
        rank -= nulls
    while low < high:
        if isinstance(low, int):
            step = (high - low) // BINS + 1
            bin_number = F.expr(f"(cast(`{name}` AS decimal(20, 0)) - {low}) div {step}")
        else:
            bin_number = F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(BINS))
        inside = rows.filter((value >= F.lit(low)) & (value <= F.lit(high)))
        counts = inside.groupBy(bin_number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for one in sorted(counts.collect(), key=lambda r: r["bin"], reverse=descending):
            if rank < one["n"]:
                low, high = one["low"], one["high"]
                break
            rank -= one["n"]
    return low, rank


def page_totals(filtered: DataFrame, limit: int = 25) -> DataFrame:
    """One row: how many rows match and how many pages they fill."""
    totals = filtered.agg(F.count(F.lit(1)).alias("total"))
    return totals.withColumn("total_pages", F.ceil(F.col("total") / F.lit(limit)).cast("bigint"))
