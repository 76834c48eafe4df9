"""Near-duplicates by SimHash and BK-trees.

Two fingerprints of 64 bits with at most three differing bits agree on one of
four bands of 16 bits, and their other 48 bits then agree on one of four parts of
12 bits. Those 28 bits name a shard of the fingerprints; each fingerprint lies in
16 shards, and whatever may be linked shares one. Each shard's fingerprints form
a BK-tree, whose children are keyed by their distance to the parent, and a search
follows only edges within the radius of the distance to the node.

Shards are found by a shuffle and not by broadcasting trees: a broadcast tree
would grow with the corpus, and at this radius a search in one tree over all
fingerprints visits most of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from voxledger.llm.components import connected_components
from voxledger.llm.runs import Union, block_pairs, sorted_runs
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

RADIUS = 3
# Spark's numbers are signed; distances count the bits of the unsigned ones.
BITS = (1 << 64) - 1
SHINGLE = 3
SEED = 42
# Nodes of one tree; a shard with more is split into pairs of trees and queries.
TREE_ROWS = 2_048


def simhash(text: str) -> int:
    """Fingerprint of a whole text, as an unsigned number; zero without words."""
    words = text.encode().lower().split()
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words] if words else []
    return majority(np.fromiter((xxh64_intdigest(b" ".join(g), SEED) for g in grams), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


@arrow_udf(LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """SimHash of each text as a signed number; a null text counts as empty."""
    return pa.array(np.array([simhash(t or "") for t in texts.to_pylist()], dtype=np.uint64).view(np.int64))


class BKTree:
    """Fingerprints as nodes; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node, children = self.root
        while True:
            distance = ((node ^ value) & BITS).bit_count()
            if distance not in children:
                children[distance] = (value, {})
                return
            node, children = children[distance]

    def within(self, value: int, radius: int) -> list[int]:
        out, todo = [], [self.root] if self.root else []
        while todo:
            node, children = todo.pop()
            distance = ((node ^ value) & BITS).bit_count()
            if distance <= radius:
                out.append(node)
            if children:
                for edge in range(distance - radius, distance + radius + 1):
                    if edge in children:
                        todo.append(children[edge])
        return out


def shard_keys(print_: Column) -> list[Column]:
    """The 16 shards of a fingerprint: number of band and part, and the 28 bits in them."""
    out = []
    for band in range(4):
        low = print_.bitwiseAND(F.lit((1 << 16 * band) - 1)) if band else F.lit(0).cast("bigint")
        high = F.shiftleft(F.shiftrightunsigned(print_, 16 * band + 16), 16 * band) if band < 3 else F.lit(0).cast("bigint")
        value, rest = F.shiftrightunsigned(print_, 16 * band).bitwiseAND(F.lit(0xFFFF)), low.bitwiseOR(high)
        for part in range(4):
            bits = F.shiftrightunsigned(rest, 12 * part).bitwiseAND(F.lit(0xFFF))
            out.append(F.shiftleft(value, 12).bitwiseOR(bits).bitwiseOR(F.lit((4 * band + part) << 28)))
    return out


def link_shard(prints: list[int], mine: list[int], lo: int, hi: int, found: Union) -> None:
    """Union what one shard links: a tree over block ``lo``, searched by block ``hi``."""
    tree = BKTree()
    for value, block in zip(prints, mine, strict=True):
        if block == lo:
            if lo == hi:
                for near in tree.within(value, RADIUS):
                    found.join(value, near)
            tree.add(value)
    if lo != hi:
        for value, block in zip(prints, mine, strict=True):
            if block == hi:
                for near in tree.within(value, RADIUS):
                    found.join(value, near)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in sorted_runs(batches, ["shard", "lo", "hi"]):
        found = Union()
        link_shard(run["print"].to_pylist(), run["mine"].to_pylist(), run["lo"][0].as_py(), run["hi"][0].as_py(), found)
        if edges := found.edges():
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def linked_prints(classes: DataFrame, print_col: str) -> DataFrame:
    """Links between distinct fingerprints, as stars of each shard's groups: ``a``, ``b``."""
    rows = classes.select(F.col(print_col).alias("print"), F.explode(F.array(*shard_keys(F.col(print_col)))).alias("shard"))
    met = block_pairs(rows, ["shard"], "print", TREE_ROWS).select("shard", "lo", "hi", "mine", "print")
    return met.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: the id, ``print`` (signed fingerprint) and ``component_id``.

    Documents with equal fingerprints are one class; classes within ``RADIUS`` bits
    are linked, and ``component_id`` is the smallest id reachable. Null and empty
    texts have fingerprint zero and link like any other. Rows with a null id belong
    to a component but do not name it: where all its ids are null, it is null.
    Repeated rows stay, an empty table gives an empty one, other columns are
    ignored.
    """
    prints = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("print")), "prints")
    classes = materialize(prints.groupBy("print").agg(F.min("id").alias("least")), "classes")
    joined = connected_components(linked_prints(classes, "print")).withColumnRenamed("id", "print")
    rooted = classes.join(joined, "print", "left").withColumn("root", F.coalesce("component", "print"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.select("print", "root").join(named, "root").select("print", "component_id")
    return prints.join(labels, "print").select(F.col("id").alias(id_col), "print", "component_id")


def keep_first(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group: those whose id is the component's.

    Rows without an id cannot be told apart and stay. Where an id is repeated, the
    least of its rows by text and then by its columns stays.
    """
    found = near_duplicates(docs.filter(F.col(id_col).isNotNull()), id_col, text_col)
    by_id = found.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows"), F.min("component_id").alias("__first"))
    kept = materialize(by_id.filter(F.col("__first") == F.col(id_col)).select(id_col, "__rows"), "kept-ids")
    out = docs.join(kept.filter("__rows = 1"), id_col, "left_semi").union(docs.filter(F.col(id_col).isNull()))
    repeated = kept.filter("__rows > 1").select(id_col)
    if not repeated.isEmpty():
        least = F.min(F.struct(F.col(text_col).alias("__text"), *(F.col(c) for c in docs.columns))).alias("__row")
        rows = docs.join(repeated, id_col, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(least)
        out = out.union(rows.select(*(F.col("__row")[c].alias(c) for c in docs.columns)))
    return out
