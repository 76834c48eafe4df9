"""Fill-in-middle documents, assembled by a secondary sort.

A text is cut into units (a word with the white space before it). A hash of the
document's id picks two cuts and the form: plain, prefix-suffix-middle or
suffix-prefix-middle. The sections go out as pieces of a bounded number of units,
keyed by document and output position; one shuffle by document with a sort inside
its partitions streams them, in output order, into a digest or a text. Restoration
reads that output alone: it finds the section marks, gives each piece its place in
the original and sorts the same partitions again, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxledger.session import ship_by_value

ship_by_value(__name__)

PREFIX, SUFFIX, MIDDLE = MARKS = (b"<P>", b"<S>", b"<M>")
# The place of each marked section in the original text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
# Units in a piece; the pieces of a long document are sorted and streamed one by one.
UNITS = 1024
SECTION_BITS = 40
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
KEY = ["doc", "content", "lane"]


class Rates(NamedTuple):
    """Which share of texts is transformed, and which share of those is suffix-first, in percent."""

    seed: int = 42
    transformed: int = 50
    suffix_first: int = 80


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    pieces: list[bytes]


def characters(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but the continuations."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def cut_text(doc: object, raw: bytes, rates: Rates) -> Cut:
    """The pieces of a text in output order; each section of a transformed text opens with its mark."""
    data = np.frombuffer(raw, dtype=np.uint8)
    white = WHITE[data]
    starts = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    edges = np.concatenate([[0], starts, [len(raw)]]) if raw else np.zeros(1, dtype=np.int64)
    n = len(edges) - 1

    def section(a: int, b: int) -> list[bytes]:
        return [raw[edges[at] : edges[min(at + UNITS, b)]] for at in range(a, b, UNITS)] or [b""]

    name = f"{rates.seed}:{'' if doc is None else doc}"
    digest = hashlib.sha256(name.encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[at : at + 4], "big") for at in range(0, 16, 4))
    if not raw or any(mark in raw for mark in MARKS) or h3 % 100 >= rates.transformed:
        return Cut(n, "plain", None, None, section(0, n))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = {PREFIX: section(0, low), MIDDLE: section(low, high), SUFFIX: section(high, n)}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < rates.suffix_first else ("psm", (PREFIX, SUFFIX, MIDDLE))
    pieces = []
    for mark in order:
        first, *rest = parts[mark]
        pieces += [mark + first, *rest]
    return Cut(n, form, characters(data[: edges[low]]), characters(data[edges[low] : edges[high]]), pieces)


def output_pieces(docs: DataFrame, id_col: str, text_col: str, rates: Rates = Rates()) -> DataFrame:
    """One row per piece of a transformed text: ``doc``, ``pos`` in the output and ``body`` (UTF-8), sorted within partitions.

    The first piece carries ``n`` (units), ``form``, ``prefix_chars`` and ``middle_chars``.
    A null or empty text is one empty piece and plain; a null id hashes as an empty one.
    ``content`` (a hash of the text) and ``lane`` (the task that read the row) belong to
    the key, so rows that share an id stay apart, and copies of one row that fill many
    tasks spread over as many groups. Equal rows of one task are equal pieces, side by
    side. An empty table gives no pieces; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [*KEY, "pos", "body", "n", "form", "prefix_chars", "middle_chars"]
    types = [None, pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        for batch in batches:
            rows, held = [], 0
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                made, content = cut_text(doc, raw, rates), hashlib.blake2b(raw, digest_size=16).digest()
                facts = (made.n, made.form, made.prefix_chars, made.middle_chars)
                for pos, body in enumerate(made.pieces):
                    rows.append((doc, content, lane, pos, body, *(facts if pos == 0 else (None,) * 4)))
                held += len(raw)
                if held > 8 << 20:
                    yield as_batch(rows, names, [batch.schema.field(0).type, *types[1:]])
                    rows, held = [], 0
            if rows:
                yield as_batch(rows, names, [batch.schema.field(0).type, *types[1:]])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("raw"))
    out = rows.mapInArrow(
        cut,
        f"doc {kind}, content binary, lane int, pos int, body binary, n bigint, form string, prefix_chars bigint, middle_chars bigint",
    )
    return out.repartition(*KEY).sortWithinPartitions(*KEY, "pos")


def as_batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict, int, bool]]:
    """Sorted pieces one by one: key, row, how many equal rows it stands for, and whether a new document begins."""
    last, row, count, opens = None, None, 0, True
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for values in zip(*columns, strict=True):
            key, pos = values[:3], values[3]
            if key == last and pos == row["pos"]:
                count += 1
                continue
            if row is not None:
                yield last, row, count, opens
            opens, last = key != last, key
            row, count = dict(zip(("pos", *batch.schema.names[4:]), values[3:], strict=True)), 1
    if row is not None:
        yield last, row, count, opens


def in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], sized: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sized(row) + 100
        if size > 8 << 20:
            yield as_batch(held, names, types)
            held, size = [], 0
    if held:
        yield as_batch(held, names, types)


def _id_type(pieces: DataFrame) -> tuple[str, pa.DataType]:
    kind = pieces.schema["doc"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def output_texts(pieces: DataFrame) -> DataFrame:
    """``doc``, ``form`` and the whole transformed ``text`` of every row behind :func:`output_pieces`."""
    kind, id_type = _id_type(pieces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        done = None
        for key, row, count, opens in streamed(batches):
            if opens:
                if done:
                    yield from [(done[0], done[1], b"".join(done[2]).decode())] * done[3]
                done = (key[0], row["form"], [], count)
            done[2].append(row["body"])
        if done:
            yield from [(done[0], done[1], b"".join(done[2]).decode())] * done[3]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), ["doc", "form", "text"], [id_type, pa.string(), pa.string()], lambda r: len(r[2]))

    return pieces.mapInArrow(assemble, f"doc {kind}, form string, text string")


def digest_output(pieces: DataFrame) -> DataFrame:
    """The pieces without marks, each with ``pos`` as its place in the original text.

    Streams every document's output into a digest, which its last piece carries as
    ``output_sha256``; ``copies`` counts equal rows. Only the form and the output itself
    decide the places.
    """
    kind, id_type = _id_type(pieces)
    facts = ["n", "form", "prefix_chars", "middle_chars"]
    names = [*KEY, "pos", "body", *facts, "copies", "output_sha256"]
    types = [pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        waiting, digest, form, place, at = None, None, None, 0, 0
        for key, row, count, opens in streamed(batches):
            if waiting:
                yield (*waiting, digest.hexdigest() if opens else None)
            if opens:
                digest, form, place = hashlib.sha256(), row["form"], 0
            body = row["body"]
            digest.update(body)
            if form != "plain" and body[:3] in PLACE:
                place, body = PLACE[body[:3]], body[3:]
            at = (place << SECTION_BITS) + row["pos"]
            waiting = (*key, at, body, *(row[f] for f in facts), count)
        if waiting:
            yield (*waiting, digest.hexdigest())

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), names, [id_type, *types], lambda r: len(r[4]))

    return pieces.mapInArrow(
        assemble,
        f"doc {kind}, content binary, lane int, pos bigint, body binary, n bigint, form string, prefix_chars bigint, "
        "middle_chars bigint, copies bigint, output_sha256 string",
    )


def digest_restored(parts: DataFrame) -> DataFrame:
    """One row per document row behind :func:`digest_output`, whose pieces are sorted again and streamed into ``restored_sha256``."""
    kind, id_type = _id_type(parts)
    facts = ["n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        doc, known, digest, copies = None, None, None, 0
        for key, row, _, opens in streamed(batches):
            if opens:
                if digest:
                    yield from [(doc, *(known[f] for f in facts), digest.hexdigest())] * copies
                doc, known, digest, copies = key[0], {}, hashlib.sha256(), 0
            digest.update(row["body"])
            known |= {f: row[f] for f in facts if row[f] is not None or f not in known}
            copies = max(copies, row["copies"])
        if digest:
            yield from [(doc, *(known[f] for f in facts), digest.hexdigest())] * copies

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), ["doc", *facts, "restored_sha256"], [id_type, *types], lambda r: 200)

    return parts.sortWithinPartitions(*KEY, "pos").mapInArrow(
        restore, f"doc {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
    )
