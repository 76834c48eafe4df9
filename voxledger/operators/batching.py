"""Consecutive batches of rows in id order, with one shuffle of the rows themselves.

Ids alone are counted, sorted by range and summed up, which gives the ids at which the
input is cut into chunks of whole batches; there are a few cuts per task, whatever the
number of rows. The rows then go to their chunks in a single shuffle and are numbered
there. Rows that share an id, or have none, are told apart by a hash of their values,
which is read only for ids that a cut falls into.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.functions.numeric import row_hash
from voxledger.operators.ordering import with_position
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

CHUNKS_PER_TASK = 4
BEFORE_ALL = -(2**63)


class Cut(NamedTuple):
    """The first row of a chunk: an id (None: rows without one) and the least hash, and the rows before it."""

    id: int | None
    tie: int
    start: int


class Chunks(NamedTuple):
    cuts: list[Cut]
    rows: int
    ties: bool

    def first_batches(self, size: int) -> list[int]:
        """Number of each chunk's first batch. A chunk cut inside equal rows may end with a short batch."""
        edges = [0, *(c.start for c in self.cuts), self.rows]
        batches = [-(-(b - a) // size) for a, b in zip(edges, edges[1:], strict=False)]
        return [0, *np.cumsum(batches[:-1]).tolist()]


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted counts the rows before each within the task."""
    before = 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n, pa.int64())], names=["id", "n", "part", "before"])
        before = int(ends[-1]) if len(ends) else before


def _counted(df: DataFrame, id_column: str) -> DataFrame:
    """Distinct ids in order with their rows, written once: narrow, however wide the rows are."""
    order = F.asc_nulls_last("id")
    counts = df.groupBy(F.col(id_column).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    placed = counts.repartitionByRange(order).sortWithinPartitions(order).select("id", "n", F.spark_partition_id().alias("part"))
    return materialize(placed.mapInArrow(_running, "id bigint, n bigint, part int, before bigint"), "counted")


def find_chunks(df: DataFrame, id_column: str, size: int) -> Chunks:
    """Where to cut the rows in id order into chunks of whole batches of ``size``."""
    spark, counted = df.sparkSession, _counted(df, id_column)
    parts = counted.groupBy("part").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).orderBy("part").collect()
    rows, ties = sum(p["rows"] for p in parts), max((p["most"] for p in parts), default=0) > 1
    wanted = CHUNKS_PER_TASK * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stride = size * max(1, -(-rows // (size * wanted)))
    starts = np.cumsum([0, *(p["rows"] for p in parts)]).tolist()
    if rows <= stride:
        return Chunks([], rows, ties)
    begins = F.try_element_at(F.create_map(*(F.lit(x) for p, s in zip(parts, starts, strict=False) for x in (p["part"], s))), F.col("part"))
    first, last = begins + F.col("before"), begins + F.col("before") + F.col("n") - 1
    inside = counted.select("id", first.alias("first"), last.alias("last")).withColumn("k", F.ceil(F.col("first") / F.lit(stride)).cast("bigint"))
    hit = inside.filter((F.greatest("k", F.lit(1)) * stride) <= F.col("last"))
    each = hit.select("id", "first", F.explode(F.sequence(F.greatest("k", F.lit(1).cast("bigint")), F.floor(F.col("last") / F.lit(stride)))).alias("k"))
    found = sorted(each.collect(), key=lambda r: r["k"])
    cuts = [Cut(r["id"], BEFORE_ALL, r["first"]) for r in found if r["k"] * stride == r["first"]]
    inner = [(r["id"], r["first"], r["k"] * stride - r["first"]) for r in found if r["k"] * stride > r["first"]]
    if inner:
        cuts += _inner_cuts(df, id_column, inner)
    return Chunks(sorted(set(cuts), key=lambda c: c.start), rows, ties)


def _inner_cuts(df: DataFrame, id_column: str, inner: list[tuple[int | None, int, int]]) -> list[Cut]:
    """Cuts among rows of one id, at the hash that lies at the wanted place. Equal rows are not parted."""
    ids = df.sparkSession.createDataFrame(sorted({(i, f) for i, f, _ in inner}, key=lambda r: r[1]), "id bigint, first bigint")
    same = F.col("rows.id").eqNullSafe(F.col("cut.id"))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), row_hash(df).alias("tie")).alias("rows")
    hashes = rows.join(F.broadcast(ids.alias("cut")), same).select("first", "tie")
    placed = materialize(with_position(hashes, "tie", [F.asc("first")]), "placed")
    base = {r["first"]: r["at"] for r in placed.groupBy("first").agg(F.min("position").alias("at")).collect()}
    at = {base[f] + offset: (i, f) for i, f, offset in inner}
    met = placed.filter(F.col("position").isin(*at)).select("first", "tie").distinct()
    least = placed.join(F.broadcast(met), ["first", "tie"]).groupBy("first", "tie").agg(F.min("position").alias("position"))
    names = {f: i for i, f, _ in inner}
    return [Cut(names[r["first"]], r["tie"], r["first"] + r["position"] - base[r["first"]]) for r in least.collect()]


def chunk_number(ids: Column, ties: Column, cuts: list[Cut]) -> Column:
    """How many cuts lie at or before a row."""
    named = [c for c in cuts if c.id is not None]
    cut_ids = np.array([c.id for c in named], dtype=np.int64)
    cut_ties = np.array([c.tie for c in cuts], dtype=np.int64)

    @arrow_udf("int")
    def number(ids: pa.Array, ties: pa.Array) -> pa.Array:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values, ties = ids.fill_null(0).to_numpy(), ties.to_numpy()
        low = np.where(known, np.searchsorted(cut_ids, values, side="left"), len(cut_ids))
        high = np.where(known, np.searchsorted(cut_ids, values, side="right"), len(cut_ties))
        out, within = low.copy(), np.flatnonzero(low < high)
        for start in np.unique(low[within]):
            rows = within[low[within] == start]
            out[rows] = start + np.searchsorted(cut_ties[start : high[rows[0]]], ties[rows], side="right")
        return pa.array(out.astype(np.int32))

    return number(ids, ties)


def consecutive_batches(df: DataFrame, id_column: str, size: int) -> DataFrame:
    """The rows with ``chunk``, ``batch_id`` and 0-based ``pos``; rows without an id come last.

    All batches hold ``size`` rows but the last, and one wherever a cut falls into rows
    that are equal in every column. The result is spread by ``chunk``, so groupings by
    (``chunk``, ``batch_id``) move nothing. An empty table has no batches.
    """
    chunks = find_chunks(df, id_column, size)
    key, tie = F.col(id_column).cast("bigint"), row_hash(df) if chunks.ties else F.lit(0).cast("bigint")
    # Evaluated next to the id alone; where there is one chunk no row visits Python.
    chunk = chunk_number(key, tie, chunks.cuts) if chunks.cuts else F.lit(0)
    order = Window.partitionBy("chunk").orderBy(F.asc_nulls_last(id_column), *([F.asc("_tie")] if chunks.ties else []))
    first = F.element_at(F.lit(chunks.first_batches(size)), F.col("chunk") + 1)
    rows = df.withColumn("chunk", chunk)
    rows = rows.withColumn("_tie", tie) if chunks.ties else rows
    placed = rows.withColumn("_place", F.row_number().over(order) - 1)
    return placed.select(
        *df.columns,
        "chunk",
        (first + F.floor(F.col("_place") / F.lit(size))).cast("bigint").alias("batch_id"),
        F.pmod("_place", F.lit(size)).cast("int").alias("pos"),
    )
