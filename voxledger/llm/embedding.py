"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the space again and again by a random direction, at the widest
gap in the middle of the projections. Vectors close to a split go to both sides.
The trees are fitted on a bounded sample and travel with the tasks; every vector
is then sent to its leaves in all trees. Leaves that hold many rows are split
further by trees of their own, fitted in the tasks on a sample of each, so that
leaves do not grow with the table. Vectors are compared within leaves, and only
pairs whose cosine is checked are linked and united.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.llm.components import connected_components
from voxledger.llm.runs import Union, block_pairs, sorted_runs
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

TREES = 6
# Vectors that fit the trees, about: the bound of what reaches the driver and travels with the tasks.
SAMPLE_ROWS = 40_000
# Rows of a leaf, about, and the fewest sampled ones that a node is split at.
LEAF_ROWS, LEAF_SAMPLE = 256, 16
# Share of a node's sample on each side of a split that goes to both.
SPILL = 0.06
# Rows of a node's sample whose pairs are looked at, directions tried where they hold so many links, and the share of
# these that a split may part; a node in which so large a share of all pairs is linked is not split otherwise.
PROBE_ROWS, TRIES, LEAST_LINKS, MOST_PARTED, DENSE = 1_024, 8, 50, 0.01, 0.02
# Rows from which a leaf is split by a tree of its own, and the rows that fit it, about.
LARGE_ROWS, LARGE_SAMPLE = 4_096, 4_096
# A leaf's number has so many bits; the number of its tree lies above them.
LEAF_BITS = 40
# Rows of one task's block of a leaf, and of one tile of the product.
BLOCK_ROWS, TILE_ROWS = 8_192, 1_024
# Tasks that a component's rows are dealt to where they meet its name.
SALTS = 16


class Node(NamedTuple):
    direction: np.ndarray
    low: float  # below: left only
    high: float  # above: right only
    left: Node | int
    right: Node | int


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    if not len(vectors):
        return np.zeros((0, 1))
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def fit_tree(sample: np.ndarray, least: int, seed: int, cosine: float) -> Node | int:
    """A tree over unit vectors; leaves are numbered from 0.

    A node is not split where it is small, where half its sample lies so close to
    its mean that any two of these are linked, or where a noticeable share of its
    pairs is linked and every split tried would part some: links would be lost there.
    """
    rng, leaves = np.random.default_rng(seed), iter(range(1 << 62))

    def cut(x: np.ndarray, direction: np.ndarray, least_share: float) -> tuple[np.ndarray, float, float]:
        n = len(x)
        along = np.sort(x @ direction)
        first, last = int(least_share * n), int((1 - least_share) * n)
        gap = int(np.argmax(np.diff(along[first : last + 1])))
        at = first + gap + 1
        middle = (along[at - 1] + along[at]) / 2
        low, high = along[max(0, at - int(SPILL * n) - 1)], along[min(n - 1, at + int(SPILL * n))]
        return direction, min(low, middle), max(high, middle)

    def turn(x: np.ndarray) -> np.ndarray:
        direction = rng.standard_normal(x.shape[1])
        return direction / np.linalg.norm(direction)

    def best(x: np.ndarray) -> tuple[np.ndarray, float, float] | None:
        split = cut(x, turn(x), 0.3)
        probe = x if len(x) <= PROBE_ROWS else x[np.linspace(0, len(x) - 1, PROBE_ROWS).astype(int)]
        near = np.triu(probe @ probe.T >= cosine, 1)
        a, b = np.nonzero(near)
        if len(a) < LEAST_LINKS:
            return split
        # The row with the most links points to the middle of a dense group, whose edge may be a gap.
        hub = probe[int(np.argmax(near.sum(0) + near.sum(1)))]
        tried = [split, *(cut(x, hub, share) for share in (0.05, 0.3)), *(cut(x, turn(x), 0.3) for _ in range(TRIES))]

        def parted(split: tuple[np.ndarray, float, float]) -> float:
            along = probe @ split[0]
            left, right = along <= split[2], along >= split[1]
            return 1 - float(((left[a] & left[b]) | (right[a] & right[b])).mean())

        losses = [parted(t) for t in tried]
        at = int(np.argmin(losses))
        dense = len(a) >= DENSE * len(probe) * (len(probe) - 1) / 2
        return None if dense and losses[at] > MOST_PARTED else tried[at]

    def grow(x: np.ndarray) -> Node | int:
        if len(x) < 2 * least:
            return next(leaves)
        mean = x.mean(0)
        if np.median(x @ mean) >= math.sqrt((1 + cosine) / 2) * np.linalg.norm(mean):
            return next(leaves)
        if (split := best(x)) is None:
            return next(leaves)
        direction, low, high = split
        shown = x @ direction
        if (shown <= high).all() or (shown >= low).all():
            return next(leaves)
        return Node(direction, low, high, grow(x[shown <= high]), grow(x[shown >= low]))

    return grow(sample)


def leaves_of(x: np.ndarray, tree: Node | int) -> list[list[int]]:
    """The leaves of each row, one or more."""
    out: list[list[int]] = [[] for _ in range(len(x))]

    def descend(rows: np.ndarray, node: Node | int) -> None:
        if not len(rows):
            return
        if not isinstance(node, Node):
            for r in rows.tolist():
                out[r].append(node)
            return
        along = x[rows] @ node.direction
        descend(rows[along <= node.high], node.left)
        descend(rows[along >= node.low], node.right)

    descend(np.arange(len(x)), tree)
    return out


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or zero, and all components finite."""
    double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    return F.coalesce(~bad & F.exists(double, lambda x: x != 0), F.lit(False))


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each length and the places of its vectors."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def fit_forest(reps: DataFrame, vector: str, rows: int, cosine: float) -> dict[int, list[Node | int]]:
    """Trees for each length, from a hashed sample of about ``SAMPLE_ROWS`` vectors of all lengths.

    A length that is too rare to be in the sample has none: its vectors are one leaf.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    part = F.pmod(F.xxhash64(vector, F.lit("sample")), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))
    sample = reps.select(vector).filter(part).toArrow()[vector].combine_chunks()
    least = max(LEAF_SAMPLE, math.ceil(LEAF_ROWS * share)) // 2
    forests = {}
    for size, at in by_length(sample):
        x = unit_rows(sample.take(at))
        # In the order of the components, so that the trees do not depend on the order of arrival.
        x = x[np.lexsort(x.T)]
        forests[size] = [fit_tree(x, least, seed, cosine) for seed in range(TREES)]
    return forests


def placed_in(vectors: pa.Array, forests: dict[int, list[Node | int]]) -> list[list[int]]:
    """The leaves of each vector in all trees of its length."""
    out: list[list[int]] = [[]] * len(vectors)
    for size, at in by_length(vectors):
        x = unit_rows(vectors.take(at))
        trees = [leaves_of(x, tree) for tree in forests.get(size, [0])]
        for place, own in zip(at.tolist(), zip(*trees, strict=True), strict=True):
            out[place] = [(t << LEAF_BITS) + leaf for t, leaves in enumerate(own) for leaf in leaves]
    return out


def packed(tree: Node | int) -> tuple | int:
    """A tree as plain tuples, which can be stored."""
    return (*tree[:3], packed(tree.left), packed(tree.right)) if isinstance(tree, Node) else tree


def unpacked(tree: tuple | int) -> Node | int:
    return Node(*tree[:3], unpacked(tree[3]), unpacked(tree[4])) if isinstance(tree, tuple) else tree


def _fit_large(cosine: float):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["size", "leaf"]):
            size, leaf, n = (run[c][0].as_py() for c in ("size", "leaf", "held"))
            x = unit_rows(run["vector"].combine_chunks())
            x = x[np.lexsort(x.T)]
            least = max(LEAF_SAMPLE, math.ceil(LEAF_ROWS * len(x) / n)) // 2
            tree = pickle.dumps(packed(fit_tree(x, least, leaf & 0x7FFFFFFF, cosine)))
            yield pa.RecordBatch.from_pylist(
                [{"size": size, "leaf": leaf, "held": n, "fitted": tree}],
                pa.schema([("size", pa.int32()), ("leaf", pa.int64()), ("held", pa.int64()), ("fitted", pa.binary())]),
            )

    return fit


def _place_large(rows: pa.Table, trees: pa.Table) -> pa.Table:
    """Leaves of one leaf's rows in its tree; both tables have been dealt to groups of about ``LARGE_ROWS`` rows."""
    parts = []
    if rows.num_rows:
        # Written by ``_fit_large`` in this job's own folder.
        tree = unpacked(pickle.loads(trees["fitted"][0].as_py()))
        parts = leaves_of(unit_rows(rows["vector"].combine_chunks()), tree)
    return rows.select(["node", "size", "leaf"]).append_column("parts", pa.array(parts, pa.list_(pa.int64())))


def split_large(classes: DataFrame, placed: DataFrame, cosine: float) -> DataFrame:
    """``node`` and ``leaves``, with every leaf of more than ``LARGE_ROWS`` rows split by a tree of its own.

    This is repeated while leaves are large and their trees split them; a tree that
    does not (a dense group) leaves its leaf whole for good. Numbers of new leaves are
    hashes: where two are equal the leaves are one, which loses no pair.
    """
    whole = None
    while True:
        each = placed.select("node", "size", F.explode("leaves").alias("leaf"))
        large = each.groupBy("size", "leaf").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > LARGE_ROWS)
        if whole is not None:
            large = large.join(whole, ["size", "leaf"], "left_anti")
        large = materialize(large, "large-leaves")
        if large.isEmpty():
            return placed
        rows = materialize(each.join(large, ["size", "leaf"]), "large-rows")
        picked = F.pmod(F.xxhash64("node", "leaf", F.lit("sample")), F.col("held")) < F.lit(LARGE_SAMPLE)
        sample = rows.filter(picked).join(classes.select("node", "vector"), "node").select("size", "leaf", "held", "vector")
        fitted = sample.repartition("size", "leaf").sortWithinPartitions("size", "leaf")
        fitted = materialize(fitted.mapInArrow(_fit_large(cosine), "size int, leaf bigint, held bigint, fitted binary"), "large-trees")
        # A tree meets its leaf's rows in groups of bounded size, once for each group.
        groups, key = F.ceil(F.col("held") / F.lit(LARGE_ROWS)), ["size", "leaf", "dealt"]
        trees = fitted.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("bigint"), groups - 1)))
        dealt = rows.join(classes.select("node", "vector"), "node").withColumn("dealt", F.pmod(F.xxhash64("node", F.lit("dealt")), groups))
        parts = dealt.groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(_place_large, "node bigint, size int, leaf bigint, parts array<bigint>")
        parts = materialize(parts, "large-parts")
        # A tree of one leaf has not split.
        cut = parts.filter(F.exists("parts", lambda p: p > 0)).select("size", "leaf").distinct()
        cut = materialize(cut, "cut-leaves")
        done = large.select("size", "leaf").join(cut, ["size", "leaf"], "left_anti")
        whole = materialize(done if whole is None else whole.union(done), "whole-leaves")
        number = F.xxhash64("leaf", "part").bitwiseAND(F.lit((1 << LEAF_BITS) - 1))
        tree = F.shiftleft(F.shiftright("leaf", LEAF_BITS), LEAF_BITS)
        fresh = parts.join(cut, ["size", "leaf"], "left_semi").select("node", "leaf", F.explode("parts").alias("part"))
        fresh = fresh.select("node", (tree + number).alias("leaf"))
        kept = each.join(cut, ["size", "leaf"], "left_anti").select("node", "leaf")
        leaves = kept.union(fresh).groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))
        placed = materialize(placed.select("node", "size").join(leaves, "node"), "placed")


class Earlier(NamedTuple):
    """The leaves before the present one that each row lies in: row ``r`` has ``leaves[starts[r] : starts[r + 1]]``."""

    starts: np.ndarray
    leaves: np.ndarray

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``rows`` and the leaves there, one entry per row and leaf."""
        counts = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - counts), counts)
        return np.repeat(np.arange(len(rows)), counts), self.leaves[at]

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which rows of one tile lie in an earlier leaf together with which of another."""
        (rows, own), (columns, other) = self.of(left), self.of(right)
        both = np.intersect1d(own, other)

        def marks(n: int, places: np.ndarray, leaves: np.ndarray) -> np.ndarray:
            out = np.zeros((n, len(both)), dtype=np.float32)
            known = np.isin(leaves, both)
            out[places[known], np.searchsorted(both, leaves[known])] = 1
            return out

        return marks(len(left), rows, own) @ marks(len(right), columns, other).T > 0


def earlier_leaves(leaves: pa.ListArray, leaf: int) -> Earlier:
    """Of each row's leaves, those with a smaller number than the present one's."""
    counts = pc.list_value_length(leaves).to_numpy(zero_copy_only=False)
    rows, numbers = np.repeat(np.arange(len(leaves)), counts), leaves.flatten().to_numpy(zero_copy_only=False)
    before = numbers < leaf
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows[before], minlength=len(leaves)))])
    return Earlier(starts, numbers[before])


def compare_leaf(
    x: np.ndarray, nodes: np.ndarray, copies: np.ndarray, met: Earlier, mine: np.ndarray, across: bool, cosine: float
) -> tuple[np.ndarray, Union]:
    """New links of a leaf's rows: how many rows each links to, and which nodes hang together.

    A pair that shares one of the leaves ``met`` before was counted there. Only tiles
    are held as matrices, so the memory does not follow the size of the leaf.
    """
    links, found = np.zeros(len(x), dtype=np.int64), Union()
    for i in range(0, len(x), TILE_ROWS):
        a = slice(i, min(len(x), i + TILE_ROWS))
        for j in range(i, len(x), TILE_ROWS):
            b = slice(j, min(len(x), j + TILE_ROWS))
            hit = x[a] @ x[b].T >= cosine
            if i == j:
                np.fill_diagonal(hit, False)
            if across:
                hit &= mine[a][:, None] != mine[b][None, :]
            rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if not len(rows):
                continue
            hit[np.ix_(rows, columns)] &= ~met.shared(rows + i, columns + j)
            links[a] += hit @ copies[b]
            if i != j:
                links[b] += hit.T @ copies[a]
            _unite(hit, nodes[a], nodes[b], found)
    return links, found


def _unite(hit: np.ndarray, left: np.ndarray, right: np.ndarray, found: Union) -> None:
    """Union the rows of a tile along its links, by spreading the smallest name until nothing changes."""
    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return
    part = hit[np.ix_(rows, columns)]
    far = np.iinfo(np.int64).max
    names, others = left[rows].copy(), right[columns].copy()
    while True:
        low_right = np.minimum(others, np.where(part, names[:, None], far).min(0))
        low_left = np.minimum(names, np.where(part, low_right[None, :], far).min(1))
        if (low_right == others).all() and (low_left == names).all():
            break
        names, others = low_left, low_right
    for node, name in zip(left[rows].tolist() + right[columns].tolist(), names.tolist() + others.tolist(), strict=True):
        found.join(node, name)


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["size", "leaf", "lo", "hi"]):
            run = run.combine_chunks()
            across = run["lo"][0].as_py() != run["hi"][0].as_py()
            nodes, copies = run["node"].to_numpy(), run["copies"].to_numpy()
            links, found = compare_leaf(
                unit_rows(run["vector"].combine_chunks()),
                nodes,
                copies,
                earlier_leaves(run["leaves"].combine_chunks(), run["leaf"][0].as_py()),
                run["mine"].to_numpy(),
                across,
                cosine,
            )
            some = np.flatnonzero(links)
            roots = [found.find(n) for n in nodes[some].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[some]), pa.array(roots, pa.int64()), pa.array(links[some])], names=["node", "root", "links"]
            )

    return compare


def near_duplicates(rows: DataFrame, id_col: str, vector_col: str, cosine: float = 0.9) -> DataFrame:
    """One row per vector: the id, ``n_links``, ``component_id`` and ``kept``.

    Equal vectors are one class, counted before any shuffle of vectors, and link to
    each other without being compared. Vectors of each length are compared among
    themselves, by a forest of their own. Null and zero vectors and those with null
    or non-finite components link with nothing and are their own component. Rows
    without an id count as links of others; they name no component, so a component
    that has no id at all is null. Rows that repeat an id with other vectors are rows
    of their own. An empty table gives an empty one; other columns are ignored.

    A leaf that stays larger than ``BLOCK_ROWS`` is compared block by block in several tasks.
    A pair that meets in several leaves is counted in the first of them.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fits = usable(F.col("vector"))
    classes = source.filter(fits).groupBy("vector").agg(F.min("id").cast("bigint").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Classes are told apart by a number of their own, which the written table fixes.
    classes = materialize(classes.select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("node")), "vector-classes")
    forests = fit_forest(classes, "vector", classes.count(), cosine)

    @arrow_udf("array<bigint>")
    def leaves(vectors: pa.Array) -> pa.Array:
        return pa.array(placed_in(vectors, forests), pa.list_(pa.int64()))

    placed = materialize(classes.select("node", "size", leaves("vector").alias("leaves")), "placed")
    placed = split_large(classes, placed, cosine)
    each = classes.select("node", "size", "copies", "vector").join(placed.drop("size"), "node").select("*", F.explode("leaves").alias("leaf"))
    met = block_pairs(materialize(each, "leaves"), ["size", "leaf"], "node", BLOCK_ROWS)
    compared = (
        met.select("size", "leaf", "lo", "hi", "mine", "node", "copies", "vector", "leaves")
        .repartition("size", "leaf", "lo", "hi")
        .sortWithinPartitions("size", "leaf", "lo", "hi")
        .mapInArrow(_compare(cosine), "node bigint, root bigint, links bigint")
    )
    links = materialize(compared, "vector-links")
    joined = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    counted = links.groupBy("node").agg(F.sum("links").alias("others"))
    rooted = classes.select("node", "least", "copies").join(counted, "node", "left").join(joined, "node", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("component", "node")).drop("component"), "vector-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # The name of a large component is asked for in several tasks.
    salted = named.select("root", "name", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    labels = rooted.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left")
    labels = labels.select(
        "node",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("name", "least").alias("component_id"),
    )
    known = classes.select("vector", "node").join(labels, "node").drop("node")
    linked = source.filter(fits).join(known, "vector").select(F.col("id").alias(id_col), "n_links", "component_id")
    alone = F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id")
    rest = source.filter(~fits).select(*alone)
    return linked.union(rest).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
