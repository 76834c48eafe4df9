"""Token ids by a public tokenizer file, each distinct chunk of the texts of a task once."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

from voxledger.llm.chunks import ChunkTable
from voxledger.session import ship_by_value

ship_by_value(__name__)

# Chunks tokenized in one call, joined by a sign that no joined chunk holds and that is a token of its own.
JOINED, MARK = 500, "\r"


def joinable(chunk: str) -> bool:
    """Whether a mark before and behind a chunk stays a match of its own: no mark inside, and visible ends."""
    return MARK not in chunk and not chunk[-1].isspace() and not chunk.removeprefix(" ")[0].isspace() and chunk.isprintable()


class WordTokens:
    """Ids of texts as unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text inside documents.
        self.tokenizer.encode_special_tokens = True
        self.mark = self._whole([MARK])[0][0]
        self.table = ChunkTable(self.segment)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segment(self, chunks: list[str]) -> list:
        """Ids of chunks, many in one call."""
        plain = np.fromiter(map(joinable, chunks), bool, len(chunks))
        out: list = [None] * len(chunks)
        places = np.flatnonzero(plain).tolist()
        groups = [places[at : at + JOINED] for at in range(0, len(places), JOINED)]
        for group, ids in zip(groups, self._whole([MARK.join([chunks[k] for k in g]) for g in groups]), strict=True):
            edges = [-1, *np.flatnonzero(np.asarray(ids) == self.mark).tolist(), len(ids)]
            for k, a, b in zip(group, edges[:-1], edges[1:], strict=True):
                out[k] = ids[a + 1 : b]
        rest = np.flatnonzero(~plain).tolist()
        for k, ids in zip(rest, self._whole([chunks[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, one behind the other, and where each text's ids end."""
        return self.table.encode(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        flat, ends = self.encode_array(pa.array(texts, pa.string()))
        data, edges = flat.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
