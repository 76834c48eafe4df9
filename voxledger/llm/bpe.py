"""Byte-level BPE as a monoid: encodings of halves are joined, decodings concatenated.

A piece (one match of the split pattern) is encoded by halving it down to short
byte strings. Two neighbouring encodings are joined by re-encoding a window of
tokens around the border. The window grows until the token left of it and its
first token, and its last token and the token right of it, are pairs that encode
to themselves. A sequence in which all adjacent pairs do so is the encoding of
its bytes: no merge across a border that both neighbours survive can come first
anywhere else. Pairs inside the untouched parts already did, so nothing outside
the window can change.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.llm.chunks import ChunkTable, steps
from voxledger.session import ship_by_value

ship_by_value(__name__)

# Bytes that are encoded directly; longer strings are halved.
LEAF_BYTES = 32
# Ids that are decoded directly.
LEAF_IDS = 512
# Pairs of neighbours whose stability is remembered.
KEPT_PAIRS = 400_000
NONE = 1 << 62


class Encoder:
    """Encodes and decodes with one rank file (token bytes and their ranks)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.pattern = regex.compile(pattern)
        self.table = ChunkTable(self.segment)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge_short(self, raw: bytes) -> list[int]:
        """As :meth:`merge`; scanning a few ranks is faster than a heap."""
        get = self.ranks.get
        cuts = list(range(len(raw) + 1))
        pairs = [get(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while pairs and (low := min(pairs)) != NONE:
            i = pairs.index(low)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(raw[cuts[i] : cuts[i + 2]], NONE)
            if i:
                pairs[i - 1] = get(raw[cuts[i - 1] : cuts[i + 1]], NONE)
        return [self.ranks[raw[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(raw) <= LEAF_BYTES:
            return self.merge_short(raw)
        ranks, n = self.ranks, len(raw)
        ends, back = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not live[i] or ends[i] == n:
                continue
            j = ends[i]
            end = ends[j]
            if ranks.get(raw[i:end]) != rank:
                continue
            live[j] = False
            ends[i] = end
            if end < n:
                back[end] = i
                if (r := ranks.get(raw[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := back[i]) >= 0 and (r := ranks.get(raw[h:end])) is not None:
                heapq.heappush(heap, (r, h))
        out, at = [], 0
        while at < n:
            out.append(ranks[raw[at : ends[at]]])
            at = ends[at]
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other encode to themselves."""
        if (known := self.pairs.get((left, right))) is None:
            known = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from their encodings."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-a:] + right[:b])))
            good_left = a >= len(left) or self.stable(left[-a - 1], window[0])
            good_right = b >= len(right) or self.stable(window[-1], right[b])
            if good_left and good_right:
                return left[: len(left) - a if a < len(left) else 0] + window + right[b:]
            a, b = (a if good_left else 2 * a), (b if good_right else 2 * b)

    def encode_half(self, raw: bytes) -> list[int]:
        """Encode by halves, joined up the tree."""
        if len(raw) <= LEAF_BYTES:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.encode_half(raw[:half]), self.encode_half(raw[half:]))

    def encode_piece(self, raw: bytes) -> list[int]:
        """One match of the split pattern; a piece that is a token stays whole."""
        return [self.ranks[raw]] if raw in self.ranks else self.encode_half(raw)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks; a chunk that is one match of the pattern needs no search."""
        out, ranks, find = [], self.ranks, self.pattern.findall
        for chunk in chunks:
            raw = chunk.encode()
            if (known := ranks.get(raw)) is not None and chunk.removeprefix(" ").isalpha():
                out.append((known,))
            elif chunk.removeprefix(" ").isalpha():
                out.append(self.encode_half(raw))
            else:
                out.append([i for piece in find(chunk) for i in self.encode_piece(piece.encode())])
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text."""
        return self.encode_array(pa.array([text], pa.string()))[0]

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts without nulls, and where each text's ids end.

        The top of the tree joins chunks at places that no match of the pattern spans:
        there no window has to be encoded again, and the join is the concatenation.
        """
        return self.table.encode(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence: those of its halves, joined up the tree."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file, once per worker."""
    with open(path, "rb") as lines:
        return Encoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of whole texts; a null text is an empty one. The file must be at ``path`` on every executor."""

    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        parts = [own.encode_array(part) for part in steps(texts.fill_null(""))]
        ends = np.concatenate([np.zeros(0, np.int64), *(np.diff(e, prepend=0) for _, e in parts)]).cumsum()
        flat = np.concatenate([np.zeros(0, np.uint32), *(ids for ids, _ in parts)]).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))

    return encoded(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes of token ids; null is empty, an id outside the vocabulary is an error."""

    @arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        own, lists = encoder(path, pattern), lists.fill_null([])
        flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        return pa.array([own.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return decoded(ids)


def encode_documents(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """The id and ``ids`` of every row, in one pass without a shuffle.

    Null and empty texts have no tokens; repeated rows, null ids and an empty table
    give what they hold; other columns are ignored.
    """
    return docs.select(F.col(id_col), encode_column(F.col(text_col), path, pattern).alias("ids"))
