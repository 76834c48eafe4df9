"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends three levels. At each level every child of the current node draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name; the
smallest draw wins. A child's draw depends on nothing but the key, its own name
and its own weight, so a changed weight moves rows only into (or out of) that
child: siblings keep their draws, and subtrees whose weights stay are untouched.

A shard that is added by :func:`grown` hangs below the root as a region of its
own. No other weight changes, so rows move into the new shard and nowhere else.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.session import materialize

# Hex digits of a draw: 52 bits, which a double holds exactly.
DIGITS = 13
SPAN = 16**DIGITS
# Rows that one task numbers; the number of slot ranges follows the row count.
ROWS_PER_RANGE = 100_000


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 40, racks: int = 8, regions: int = 4) -> tuple[Leaf, ...]:
    """``shards`` equal leaves, dealt in runs to racks and regions."""
    return tuple(Leaf(s * regions // shards, s * racks // shards, s) for s in range(shards))


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, as a region of its own."""
    return (*tree, Leaf(*(max(getattr(x, level) for x in tree) + 1 for level in ("region", "rack", "shard")), weight))


def hashed(key: Column, name: Column | str) -> Column:
    """52 bits from a key and a name; a null key hashes like an empty one."""
    name = F.lit(name) if isinstance(name, str) else name
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit("#"), name)
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint")


def _children(tree: tuple[Leaf, ...], level: str, parent: str | None) -> dict[int, dict[int, float]]:
    """Weights of the children below each parent: sums over their leaves."""
    out: dict[int, dict[int, float]] = {}
    for leaf in tree:
        below = out.setdefault(getattr(leaf, parent) if parent else 0, {})
        below[getattr(leaf, level)] = below.get(getattr(leaf, level), 0.0) + leaf.weight
    return out


def _pick(key: Column, level: str, children: dict[int, dict[int, float]], parent: Column) -> Column:
    listed = F.create_map(
        *(
            part
            for node, below in children.items()
            for part in (
                F.lit(node),
                F.array(*(F.struct(F.lit(c).alias("child"), F.lit(float(w)).alias("weight")) for c, w in below.items())),
            )
        )
    )

    def draw(c: Column) -> Column:
        u = (hashed(key, F.concat(F.lit(f"{level} "), c["child"].cast("string"))) + 0.5) / SPAN
        return F.struct((-F.ln(u) / c["weight"]).alias("cost"), c["child"].alias("child"))

    return F.array_min(F.transform(F.element_at(listed, parent), draw))["child"]


def place(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a key, as an expression: no shuffle, no state."""
    tree = tuple(leaf for leaf in tree if leaf.weight > 0)
    if not tree:
        raise ValueError("a tree needs a shard with a weight above zero")
    region = _pick(key, "region", _children(tree, "region", None), F.lit(0))
    rack = _pick(key, "rack", _children(tree, "rack", "region"), region)
    return _pick(key, "shard", _children(tree, "shard", "rack"), rack)


def shard_rows(rows: DataFrame, id_col: str, text_col: str, tree: tuple[Leaf, ...]) -> DataFrame:
    """Shard, place in the shard and next shard of every row.

    Columns: the id, ``size`` (UTF-8 bytes of the text plus 16), ``text_crc32``,
    ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (where the
    row lies once :func:`grown` has added a shard). A null text is an empty one; a
    null id is placed by the empty key; repeated rows share a shard and get slots
    of their own; an empty table gives an empty one; other columns are ignored.

    Slots follow the hashed key. Equal rows are counted before the shuffle and
    spread again after numbering, so a key with a third of all rows is one row
    in the window. A range of the hash holds about ``ROWS_PER_RANGE`` rows.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    placed = materialize(
        rows.select(
            key.alias("id"),
            (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            place(key, tree).alias("shard"),
            place(key, grown(tree)).alias("grown_shard"),
            hashed(key, "slot").alias("lane"),
        ),
        "placed",
    )
    ranges = max(1, placed.count() // (ROWS_PER_RANGE * len(tree)))
    width = SPAN >> max(0, math.ceil(math.log2(ranges)))
    counted = (
        placed.groupBy("id", "size", "text_crc32", "shard", "grown_shard", "lane")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("range", F.floor(F.col("lane") / F.lit(width)))
    )
    inside = Window.partitionBy("shard", "range").orderBy("lane", "id", "size", "text_crc32")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("shard", F.floor(F.col("lane") / F.lit(width)).alias("range")).agg(F.count(F.lit(1)).alias("held"))
    starts = sizes.select("shard", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    first = F.coalesce(F.sum("copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        counted.withColumn("first", first)
        .join(starts, ["shard", "range"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            "shard",
            F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("first") + F.col("copies") - 1)).alias("slot"),
            "grown_shard",
        )
    )
