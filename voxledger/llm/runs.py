"""Groups of rows that meet in a task: bounded blocks, and runs of equal keys in sorted batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.session import ship_by_value

ship_by_value(__name__)


def block_pairs(rows: DataFrame, key: Sequence[str], ident: str, max_rows: int) -> DataFrame:
    """Rows dealt to pairs of blocks, so that any two rows of a group meet exactly once.

    A group of at most ``max_rows`` is one block and meets itself. A larger one is
    split by a hash of ``ident`` (unique in a group) into b blocks, and each row
    goes to the b pairs of its own block; no task holds more than two blocks.
    Groups of one row are left out. Adds ``mine``, ``lo`` and ``hi``: in a pair with
    ``lo < hi`` only rows of different blocks are compared.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    blocks = F.ceil(F.col("held") / F.lit(max_rows)).cast("int")
    split = rows.join(sizes, list(key)).withColumn("blocks", blocks)
    split = split.withColumn("mine", F.pmod(F.xxhash64(F.col(ident), F.lit("block")), F.col("blocks")).cast("int"))
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("held", "blocks", "other")


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal integer keys, across batch borders."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *turn.tolist()]
        for start, end in zip(edges, edges[1:], strict=False):
            yield table.slice(start, end - start)
        held = table.slice(edges[-1])
    if held is not None:
        yield held


class Union:
    """Which of the values in a task hang together; the smallest value stands for the rest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        top = x
        while (up := self.parent.get(top, top)) != top:
            top = up
        while (up := self.parent.get(x, x)) != top:
            self.parent[x] = top
            x = up
        return top

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def edges(self) -> list[tuple[int, int]]:
        """A star per component: each other member with the smallest."""
        return [(x, self.find(x)) for x in list(self.parent)]
