"""Sum-of-squares online packing of documents into windows of a fixed length.

Documents longer than a window fill whole windows first. What is left of each is
placed, as it arrives, at the fill level that minimises the sum over levels of the
squared number of partly filled windows; the counts are one array indexed by
level. Each task packs the rows it reads, in one pass and without a shuffle. At a
task's end the windows still open are emptied and their pieces cut to fill whole
windows, so at most one window per task is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.llm.chunks import steps
from voxledger.llm.tokens import word_tokens
from voxledger.session import ship_by_value

ship_by_value(__name__)

# Local numbers of windows in a task; the task's number stands above them.
LANE_BITS = 40


class Piece(NamedTuple):
    doc: object
    start: int
    ids: bytes
    doc_tokens: int


class Packer:
    """One lane: open windows by fill level, and the closed ones' pieces."""

    def __init__(self, capacity: int, lane: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(capacity + 1)]
        self.next_id = lane << LANE_BITS
        self.closed: list[tuple[Piece, int, int]] = []

    def close(self, window: list[Piece]) -> None:
        at = 0
        for piece in window:
            self.closed.append((piece, self.next_id, at))
            at += len(piece.ids) // 4
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """Level (0: a new window) whose choice leaves the least sum of squares; ties go to the fullest."""
        levels = np.flatnonzero(self.counts[: self.capacity - size + 1])
        # Moving a window from h to h + s changes the sum by 2 (N[h+s] - N[h] + 1); full windows do not count.
        cost = np.where(levels + size == self.capacity, 1 - 2 * self.counts[levels], 2 * (self.counts[levels + size] - self.counts[levels] + 1))
        fresh = 2 * self.counts[size] + 1
        if not len(levels) or cost.min() > fresh:
            return 0
        return int(levels[len(cost) - 1 - np.argmin(cost[::-1])])

    def place(self, piece: Piece, size: int) -> None:
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            self.close(window)
        else:
            self.open[level + size].append(window)
            self.counts[level + size] += 1

    def add(self, doc: object, ids: bytes) -> None:
        """Place a document: whole windows, then what is left."""
        n, step = len(ids) // 4, 4 * self.capacity
        full = len(ids) // step * step
        for at in range(0, full, step):
            self.close([Piece(doc, at // 4, ids[at : at + step], n)])
        if full < len(ids):
            self.place(Piece(doc, full // 4, ids[full:], n), (len(ids) - full) // 4)

    def finish(self) -> None:
        """Refill the open windows' pieces into whole windows, cutting where one is full."""
        window, free = [], self.capacity
        for level in range(self.capacity, 0, -1):
            for held in self.open[level]:
                for piece in held:
                    while len(piece.ids) // 4 >= free:
                        cut = 4 * free
                        window.append(piece._replace(ids=piece.ids[:cut]))
                        self.close(window)
                        piece = piece._replace(start=piece.start + free, ids=piece.ids[cut:])
                        window, free = [], self.capacity
                    if piece.ids:
                        window.append(piece)
                        free -= len(piece.ids) // 4
            self.open[level] = []
        if window:
            self.close(window)

    def taken(self, id_type: pa.DataType) -> pa.RecordBatch:
        rows, self.closed = self.closed, []
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p.doc for p, _, _ in rows], id_type),
                pa.array([p.start for p, _, _ in rows], pa.int64()),
                pa.array([len(p.ids) // 4 for p, _, _ in rows], pa.int64()),
                pa.array([p.ids for p, _, _ in rows], pa.binary()),
                pa.array([p.doc_tokens for p, _, _ in rows], pa.int64()),
                pa.array([s for _, s, _ in rows], pa.int64()),
                pa.array([o for _, _, o in rows], pa.int64()),
            ],
            names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a window.

    Columns: the id, ``start`` and ``length`` in the document, ``ids`` (little-endian
    unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id`` and ``offset``. A document is
    its text's ids and then ``end_id``; a null or empty text is that id alone, a null
    id stays null, repeated rows are packed each, an empty table gives no pieces,
    other columns are ignored. Window numbers name the task and the window in it; a
    task that is run again packs the same rows in the same order. A task holds the
    ids of its open windows, never more than those of the rows that it reads.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = Packer(capacity, TaskContext.get().partitionId()), np.array([end_id], dtype="<u4").tobytes()
        tokens, id_type = word_tokens(path), None
        for batch in batches:
            id_type, names, at = batch.schema.field(0).type, batch.column(0).to_pylist(), 0
            for texts in steps(batch.column(1).fill_null("")):
                flat, ends = tokens.encode_array(texts)
                data, start = flat.astype("<u4").tobytes(), 0
                for doc, stop in zip(names[at : at + len(texts)], (4 * ends).tolist(), strict=True):
                    packer.add(doc, data[start:stop] + end)
                    start = stop
                at += len(texts)
                if packer.closed:
                    yield packer.taken(id_type)
        packer.finish()
        if packer.closed:
            yield packer.taken(id_type)
        # The worker goes on to other tasks; what this one held is given back.
        pa.default_memory_pool().release_unused()

    out = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        pack, f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    return out.withColumnRenamed("doc", id_col)
