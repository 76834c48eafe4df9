"""Ids of texts from a table of their distinct chunks.

Byte-level tokenizers first cut a text by a pattern. None of its matches spans the
place before a space between two visible characters, or the place between a letter
and a stop or comma behind it: a match may hold a space only in front, and holds
letters or signs, not both, but for contractions, which begin with an apostrophe.
A match begins at each such place whatever stands before it, so the chunks between
them are tokenized by themselves, each distinct one once, and the ids of a text are
the table's rows joined by position, as array operations on a batch of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxledger.session import ship_by_value

ship_by_value(__name__)

# Text worked on at once, and what a table may hold between calls.
STEP_BYTES, TABLE_BYTES = 4 << 20, 32 << 20

LETTER, STOP, SEEN, LAST = (np.zeros(256, dtype=bool) for _ in range(4))
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
STOP[[ord(c) for c in ".,;:!?"]] = True
# First bytes of characters that are surely visible; E1 to E3 and C2 begin some spaces, too.
SEEN[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
# Last bytes of characters that are surely visible, whatever their first byte.
LAST[range(0x21, 0xC0)] = True
LAST[[0x7F, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def bounds(strings: pa.Array) -> np.ndarray:
    """Offsets of the values of a string or binary array in its data."""
    return np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]


def steps(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts that hold about ``STEP_BYTES`` together, one text at least."""
    ends, start = bounds(texts), 0
    while start < len(texts):
        stop = max(int(np.searchsorted(ends, ends[start] + STEP_BYTES, side="right")) - 1, start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def cut_places(data: np.ndarray) -> np.ndarray:
    """Whether a chunk may begin at each byte."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) < 3:
        return cut
    before, here, after = data[:-2], data[1:-1], data[2:]
    # The second byte of a character of two bytes is visible unless its first is C2.
    two = np.concatenate([[False], (data[:-3] >= 0xC3) & (data[:-3] <= 0xDF)])
    cut[1:-2] = (here == 0x20) & SEEN[after] & (LAST[before] | (two & (before >= 0x80)))
    cut[1:-2] |= LETTER[before] & STOP[here]
    return cut


class ChunkTable:
    """Distinct chunks and their ids; ``segment`` tokenizes new ones."""

    def __init__(self, segment: Callable[[list[str]], list]) -> None:
        self.segment = segment
        self.forget()

    def forget(self) -> None:
        self.chunks, self.ids, self.edges = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _rows(self, distinct: pa.Array) -> np.ndarray:
        rows = pc.index_in(distinct, value_set=self.chunks).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = distinct.filter(pa.array(rows < 0))
        rows[rows < 0] = np.arange(len(self.chunks), len(self.chunks) + len(new))
        found = self.segment(new.to_pylist())
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, *(np.asarray(ids, dtype=np.uint32) for ids in ([i for part in found for i in part],) if ids)])
        self.chunks = pa.concat_arrays([self.chunks, new])
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, one behind the other, and where each text's ids end."""
        at = bounds(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
        cut = cut_places(data)
        cut[at - at[0]] = True
        edges = np.flatnonzero(cut).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.edges[rows + 1] - self.edges[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(self.edges[rows] - ends[:-1], lengths)
        places += np.arange(ends[-1])
        flat = self.ids[places]
        if self.chunks.nbytes + self.ids.nbytes > TABLE_BYTES:
            self.forget()
        return flat, ends[np.searchsorted(edges, at[1:] - at[0])]
