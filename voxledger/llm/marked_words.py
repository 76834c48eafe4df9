"""SentencePiece ids by a table of distinct chunks.

Where no piece of a model crosses from a word into the white space behind it, a text
falls into marked words, each a run of spaces with what follows it. Every distinct
one is segmented once by the library and kept in a table; the ids of a text are the
table's rows joined back by the positions of its words. Decoding looks every id up
in the table of pieces in the same way. Both are array operations on whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.session import ship_by_value

ship_by_value(__name__)

# Text worked on at once, and what the table of a worker may hold between batches.
STEP_BYTES, TABLE_BYTES = 8 << 20, 32 << 20
MARKER = "▁"
# Signs that normalisation rules are known to change.
PROBE = "a  　①ﬁÅ 가  b"


def steps(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows that hold about ``most`` bytes together, one row at least."""
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def bounds(strings: pa.Array) -> np.ndarray:
    """Offsets of the values of a string or binary array in its data."""
    return np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``values`` one behind the other, and where each ends."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - ends + lengths, lengths) + np.arange(total)], ends


class PieceModel:
    """One model file: its table of distinct marked words, and its table of pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
        marked = MARKER + PROBE.replace(" ", MARKER)
        # Otherwise a text is one chunk.
        self.by_words = library.normalize(PROBE) == marked and MARKER in pieces and not any(MARKER in p.lstrip(MARKER) for p in pieces)
        self.end = library.eos_id()
        self.surfaces = pa.array([self._surface(i, p) for i, p in enumerate(pieces)], pa.binary())
        self.silent = np.array([library.is_control(i) for i in range(len(pieces))])
        self.opens = np.array([p.startswith(MARKER) for p in pieces])
        self.unknown = np.array([library.is_unknown(i) for i in range(len(pieces))])
        self.forget()

    def _surface(self, number: int, piece: str) -> bytes:
        if self.library.is_control(number):
            return b""
        if self.library.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(MARKER, " ").encode()

    def forget(self) -> None:
        self.words, self.ids, self.edges = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The marked words of texts, and at which of them each text begins; the library adds the first marker itself."""
        marks = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
        marked = pc.binary_join_element_wise(marks, texts, pa.scalar(""))
        at, data = bounds(marked), np.frombuffer(marked.buffers()[2] or b"", dtype=np.uint8)
        cut = np.zeros(max(len(data), 1) + 1, dtype=bool)
        if self.by_words:
            space = data == 0x20
            # 0x81 may be the last byte of a marker that stands in the text and counts as a space.
            cut[1 : len(data)] = space[1:] & ~space[:-1] & (data[:-1] != 0x81)
        cut[at] = True
        edges = np.flatnonzero(cut[: at[-1] + 1]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), marked.buffers()[2])
        return words, np.searchsorted(edges, at)

    def learn(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words in the table; those it does not hold are segmented and added."""
        rows = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = words.filter(pa.array(rows < 0))
        rows[rows < 0] = np.arange(len(self.words), len(self.words) + len(new))
        found = self.library.encode([w[1:] for w in new.to_pylist()], num_threads=1)
        # A space that ends a text: the library gives an empty text no marker.
        found = [ids or [self.library.piece_to_id(MARKER)] for ids in found]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        fresh = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, fresh])
        self.words = pa.concat_arrays([self.words, new])
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, each closed by the end id, and where each text's ids end."""
        words, first = self.chunks(texts)
        coded = words.dictionary_encode()
        rows = self.learn(coded.dictionary)[coded.indices.to_numpy()]
        flat, ends = gather(self.ids, self.edges[rows], self.edges[rows + 1] - self.edges[rows])
        if self.words.nbytes + self.ids.nbytes > TABLE_BYTES:
            self.forget()
        ends = np.concatenate([[0], ends])[first[1:]]
        return np.insert(flat, ends, self.end), ends + np.arange(1, len(ends) + 1)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id sequences; what is not plain pieces behind a marker goes to the library."""
        taken = self.surfaces.take(pa.array(ids))
        at, data, out, start = bounds(taken), taken.buffers()[2], [], 0
        data = memoryview(data) if data else memoryview(b"")
        loud = np.flatnonzero(~self.silent[ids])
        opener = np.searchsorted(loud, np.concatenate([[0], ends[:-1]]).astype(np.int64))
        odd = np.flatnonzero(self.unknown[ids])
        for end, number in zip(ends.tolist(), opener.tolist(), strict=True):
            raw = bytes(data[at[start] : at[end]])
            plain = not raw or self.opens[ids[loud[number]]]
            if plain and np.searchsorted(odd, start) == np.searchsorted(odd, end):
                try:
                    out.append(raw[1:].decode())
                except UnicodeDecodeError:
                    out.append(self.library.decode(ids[start:end].tolist()))
            else:
                out.append(self.library.decode(ids[start:end].tolist()))
            start = end
        return out


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model of a file, once per worker."""
    return PieceModel(path)


def encode_column(text: Column, path: str) -> Column:
    """Ids of whole texts as the library gives them, with the end id and no other special id.

    A null text is an empty one: the end id alone. The file must be at ``path`` on every executor.
    """

    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        own, texts = piece_model(path), texts.fill_null("")
        sizes = np.diff(bounds(texts))
        parts = [own.encode(texts.slice(a, b - a)) for a, b in steps(sizes, STEP_BYTES)]
        lengths = [np.diff(ends, prepend=0) for _, ends in parts]
        edges = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *lengths]))]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in parts)])
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))

    return encoded(text)


def decode_column(ids: Column, path: str) -> Column:
    """Texts of id sequences as the library gives them; null is an empty sequence, an id outside the model is an error."""

    @arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        own, lists = piece_model(path), lists.fill_null([])
        edges, out = lists.offsets.to_numpy(), []
        values = lists.values.to_numpy(zero_copy_only=False)
        for a, b in steps(4 * np.diff(edges), STEP_BYTES):
            out += own.decode(values[edges[a] : edges[b]], edges[a + 1 : b + 1] - edges[a])
        return pa.array(out, pa.string())

    return decoded(ids)


def encode_documents(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """The id and ``ids`` of every row, in one pass without a shuffle.

    Null and empty texts are the end id alone; a text without spaces, however long, is
    one chunk; repeated rows and null ids give a row each, an empty table none; other
    columns are ignored, also ones named ``ids``. A task keeps a table of at most
    ``TABLE_BYTES`` between batches and begins a new one beyond that.
    """
    return docs.select(F.col(id_col), encode_column(F.col(text_col), path).alias("ids"))
