"""Near copies by SimHash and the Jaccard similarity of word shingles, checked exactly.

A text is the set of its five-word shingles; two texts are linked where the sets'
Jaccard similarity reaches the threshold. Each set has a SimHash fingerprint, and
what the BK-trees of ``simhash`` link is compared by whole sets. Within their radius
lie only the nearest copies: at 0.8 two fingerprints of 64 bits differ in about ten
bits, at times in fourteen. So texts that share a MinHash band are compared too; a
pair at 0.8 shares none once in 300,000 pairs. Links below the threshold are never made.

First every row of a bucket meets the bucket's least row, which joins most of a large
group at a cost in proportion to its rows. Then only what is not yet joined meets the
rest of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from xxhash import xxh64_intdigest

from voxledger.llm.components import connected_components
from voxledger.llm.runs import Union, sorted_runs
from voxledger.llm.simhash import linked_prints, majority
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

SHINGLE, SIMILARITY = 5, 0.8
# Least values in a band, and bands: a pair at 0.8 shares no band with probability (1 - 0.8^4)^24, 3 in a million.
BAND_ROWS, BANDS = 4, 24
# Texts of one task's block of a bucket; a larger one is split into pairs of blocks.
BUCKET_ROWS = 2_048
SEED = 42
# Words whose hashes a worker keeps.
KEPT_WORDS = 50_000
# Texts whose sets a worker holds at once.
SLICE_ROWS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Row(NamedTuple):
    name: int
    shingles: np.ndarray


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxh64_intdigest(word, SEED)
        return value


_WORDS = _Words()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of a text's shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    size = min(shingle, len(words))
    if not size:
        return np.zeros(0, dtype=np.uint64)
    each = np.fromiter((_WORDS[w] for w in words), dtype=np.uint64, count=len(words))
    n = len(each) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _ODD + each[k : k + n])
    return np.unique(out)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def set_print(shingles: np.ndarray) -> int:
    """A signed number for a whole set."""
    return _signed(xxh64_intdigest(shingles.tobytes(), SEED))


def bands(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set's bands as signed numbers; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, dtype=np.int64)
    draws = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BAND_ROWS * BANDS, 1), dtype=np.uint64)
    times, plus = draws[0] | np.uint64(1), draws[1]
    least = np.full(BAND_ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512] * times + plus).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, BAND_ROWS).T:
        keys = _mix(keys * _ODD + part)
    return keys.view(np.int64)


def sketch(text: Column, shingle: int) -> Column:
    """``print`` of a text's set, its SimHash ``fingerprint`` and the keys of its bands."""

    @arrow_udf("struct<print: bigint, fingerprint: bigint, bands: array<bigint>>")
    def sketches(texts: pa.Array) -> pa.Array:
        named, near, keys = [], [], []
        for text in texts:
            found = shingle_set(text.as_py(), shingle)
            named.append(set_print(found))
            near.append(_signed(majority(found)))
            keys.append(bands(found))
        columns = [pa.array(named, pa.int64()), pa.array(near, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, names=["print", "fingerprint", "bands"])

    return sketches(text)


def with_sets(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """Rows with a text's ``found`` print and ``shingles`` in place of the text, a bounded number of sets at a time."""
    kept = rows.drop(text_col)
    names = kept.columns

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = [shingle_set(t.as_py(), shingle) for t in part.column(text_col)]
                columns = [part.column(c) for c in names]
                columns += [pa.array([set_print(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "found", "shingles"])

    return rows.mapInArrow(attach, StructType([*kept.schema.fields, StructField("found", LongType()), StructField("shingles", BinaryType())]))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets' Jaccard similarity reaches the threshold."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few) or len(few) / len(many) < similarity:
        return False
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    return both / (len(a) + len(b) - both) >= similarity


def link_bucket(rows: list[Row], mine: list[int], lo: int, hi: int, similarity: float, found: Union) -> None:
    """Union what one bucket links; a row is compared with a group until one of its members links."""
    groups: dict[int, list[Row]] = {}

    def meet(row: Row) -> int:
        for root in list(groups):
            top = found.find(row.name)
            # A group the row was in may have gone into another one that it met before.
            if root in groups and root != top and any(alike(row.shingles, other.shingles, similarity) for other in groups[root]):
                found.join(row.name, root)
                new = found.find(root)
                joined = [*groups.pop(root), *(groups.pop(top, []))]
                groups.setdefault(new, []).extend(joined)
        return found.find(row.name)

    if lo == hi:
        for row in rows:
            top = meet(row)
            groups.setdefault(top, []).append(row)
        return
    for row, block in zip(rows, mine, strict=True):
        if block == lo:
            groups.setdefault(found.find(row.name), []).append(row)
    for row, block in zip(rows, mine, strict=True):
        if block == hi:
            meet(row)


def _links(similarity: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in sorted_runs(batches, ["bucket", "lo", "hi"]):
            found, names = Union(), run["print"].to_pylist()
            for name, component in zip(names, run["component"].to_pylist(), strict=True):
                found.join(name, component)
            rows = [Row(n, np.frombuffer(s.as_buffer(), dtype=np.uint64)) for n, s in zip(names, run["shingles"], strict=True)]
            link_bucket(rows, run["mine"].to_pylist(), run["lo"][0].as_py(), run["hi"][0].as_py(), similarity, found)
            if edges := found.edges():
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return link


def _buckets(nodes: DataFrame) -> DataFrame:
    """``bucket``, ``print`` and ``component`` of buckets that hold several components; those with the same rows count once."""
    rows = nodes.select("print", "component", F.explode("bands").alias("bucket"))
    # Two hashes and the number of rows stand for what a bucket holds.
    held = F.bit_xor(F.xxhash64("print")).alias("held"), F.bit_xor(F.xxhash64(F.lit(SEED), "print")).alias("also"), F.count(F.lit(1)).alias("n")
    open_ = rows.groupBy("bucket").agg(*held, F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return rows.join(open_.groupBy("held", "also", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Prints ``a`` < ``b`` whose fingerprints the BK-trees link: stars, also of each fingerprint's own prints."""
    classes = materialize(nodes.groupBy("fingerprint").agg(F.min("print").alias("first")), "fingerprints")
    of = classes.select("fingerprint", "first")
    linked = linked_prints(classes, "fingerprint").distinct()
    linked = linked.join(of.toDF("a", "one"), "a").join(of.toDF("b", "other"), "b").select("one", "other")
    equal = nodes.select("fingerprint", "print").join(of, "fingerprint").select("first", "print")
    return _pairs(linked.union(equal))


def star_pairs(buckets: DataFrame) -> DataFrame:
    """Prints ``a`` < ``b``: each row of a bucket with the bucket's least."""
    least = buckets.groupBy("bucket").agg(F.min("print").alias("first"))
    return _pairs(buckets.join(least, "bucket").select("first", "print"))


def _pairs(rows: DataFrame) -> DataFrame:
    one, other = (F.col(c) for c in rows.columns)
    return rows.filter(one != other).select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets reach the threshold. A print with many pairs goes to several tasks."""

    @arrow_udf("boolean")
    def reach(left: pa.Array, right: pa.Array) -> pa.Array:
        both = ((np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in pair) for pair in zip(left, right, strict=True))
        return pa.array([alike(a, b, similarity) for a, b in both], pa.bool_())

    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_ROWS)).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    others = dealt.select("a", "b", "block").join(sets.select(F.col("print").alias("b"), F.col("shingles").alias("right")), "b")
    firsts = sizes.join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("left")), "a")
    firsts = firsts.select("a", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return others.join(firsts, ["a", "block"]).filter(reach(F.col("left"), F.col("right"))).select("a", "b")


def bucket_blocks(buckets: DataFrame, max_rows: int) -> DataFrame:
    """Rows dealt to pairs of blocks, so that any two rows of a bucket meet once unless both are in its largest component.

    A bucket of at most ``max_rows`` is one block and meets itself. In a larger one the
    largest component has blocks of its own, which meet the others but not one another.
    Adds ``mine``, ``lo`` and ``hi`` as :func:`voxledger.llm.runs.block_pairs` does.
    """
    parts = buckets.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", "component")).alias("top")
    sizes = parts.groupBy("bucket").agg(F.sum("n").alias("held"), top).filter(F.col("held") > F.col("top.n"))
    whole = F.col("held") <= F.lit(max_rows)
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("top.n") / F.lit(max_rows))).cast("int")
    others = F.when(whole, 1).otherwise(F.ceil((F.col("held") - F.col("top.n")) / F.lit(max_rows))).cast("int")
    sizes = sizes.select("bucket", F.col("top.component").alias("main"), mains.alias("mains"), others.alias("others"))
    hashed, main = F.xxhash64("print", F.lit("block")), (F.col("component") == F.col("main")) & (F.col("mains") > 0)
    mine = F.when(main, F.pmod(hashed, F.greatest("mains", F.lit(1)))).otherwise(F.col("mains") + F.pmod(hashed, F.col("others")))
    split = buckets.join(sizes, "bucket").withColumn("mine", mine.cast("int"))
    first = F.when(main, F.col("mains")).otherwise(0)
    met = split.withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)))
    met = met.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
    return met.drop("main", "mains", "others", "other")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``print`` and ``shingles`` of the wanted prints, from the texts of their least ids."""
    named = docs.join(wanted.filter("not nameless").select("id", "print"), "id").select("print", "text")
    # A repeated id brings its other texts along.
    named = with_sets(named, "text", shingle).filter("found = print").select("print", "shingles")
    others = with_sets(docs.filter(F.col("id").isNull()).select("text"), "text", shingle).withColumnRenamed("found", "print")
    others = others.join(wanted.filter("nameless").select("print"), "print", "left_semi")
    return named.union(others.groupBy("print").agg(F.first("shingles").alias("shingles")))


def components(docs: DataFrame, prints: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``print`` and ``component`` of every distinct set that links to another."""
    firsts = F.first("fingerprint").alias("fingerprint"), F.first("bands").alias("bands")
    nodes = prints.groupBy("print").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id")).alias("of"), *firsts)
    # Sets without shingles have no bands and are one print; they link to nothing else.
    nodes = materialize(nodes.select("print", "of.nameless", "of.id", "fingerprint", "bands"), "sets").withColumn("component", F.col("print"))
    buckets = materialize(_buckets(nodes), "buckets")
    pairs = materialize(near_pairs(nodes.filter(F.size("bands") > 0)).union(star_pairs(buckets)).distinct(), "pairs")
    wanted = buckets.select("print").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = materialize(_sets(docs, nodes.select("print", "nameless", "id").join(wanted, "print"), shingle), "shingles")
    edges = materialize(checked(pairs, sets, similarity), "pair-links")
    known = connected_components(edges).select(F.col("id").alias("print"), F.col("component").alias("known"))
    nodes = nodes.join(known, "print", "left").withColumn("component", F.coalesce("known", "print")).drop("known")
    met = bucket_blocks(materialize(_buckets(nodes), "buckets"), BUCKET_ROWS)
    rows = met.join(sets, "print").select("bucket", "lo", "hi", "mine", "print", "component", "shingles")
    linked = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(_links(similarity), "a bigint, b bigint")
    joined = connected_components(edges.union(materialize(linked, "copy-links")))
    return joined.withColumnRenamed("id", "print")


def keep_first(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near copies: the one with the least id, null ids last.

    Texts with the same shingles are one group, those without words too. Rows and
    not ids are decided on: where an id stands for several texts, each belongs to
    its own group, and of rows that share id and shingles the least by text and
    then by its columns as JSON stays. An empty table gives an empty one.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialize(source.select("id", sketch(F.col("text"), shingle).alias("s")).select("id", "s.*"), "prints")
    joined = components(source, prints, similarity, shingle)
    rows = prints.groupBy("id", "print").agg(F.count(F.lit(1)).alias("rows")).join(joined, "print", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "print")), "labelled")
    head = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "print")).alias("head"))
    # Heads meet their own rows only, so that a large group is spread by id and text.
    heads = head.select("head.id", "head.print", F.lit(True).alias("kept")).alias("heads")
    own = F.col("rows.id").eqNullSafe(F.col("heads.id")) & (F.col("rows.print") == F.col("heads.print"))
    judged = rows.alias("rows").join(heads, own, "left").select("rows.id", "rows.print", "rows.rows", F.coalesce("kept", F.lit(False)).alias("kept"))
    kept = materialize(judged, "judged")
    by_id = kept.filter("id is not null").groupBy("id").agg(F.sum("rows").alias("n"), F.every("kept").alias("kept"))
    touched = materialize(by_id.filter("n > 1 or not kept").select(F.col("id").alias(id_col), "n"), "touched")
    out = docs.filter(F.col(id_col).isNotNull()).join(touched.select(id_col), id_col, "left_anti").select(*docs.columns)
    # Null and repeated ids: told apart by their shingles too.
    repeated = touched.filter("n > 1").select(F.col(id_col).alias("id"))
    odd = materialize(kept.filter("kept").join(repeated, "id", "left_semi").union(kept.filter("kept and id is null")).select("id", "print"), "odd-rows")
    if not odd.isEmpty():
        whole = F.struct(*docs.columns).alias("row")
        own = docs.select(whole, F.col(id_col).alias("id"), sketch(F.col(text_col), shingle).alias("s")).select("row", "id", "s.print").alias("own")
        same = (F.col("own.print") == F.col("odd.print")) & F.col("own.id").eqNullSafe(F.col("odd.id"))
        # Columns of any type have a JSON form, also those without an order.
        order = F.struct(F.col("row")[text_col], F.to_json("row", {"ignoreNullFields": "false"}))
        least = own.join(odd.alias("odd"), same, "left_semi").groupBy("id", "print").agg(F.min_by("row", order).alias("row"))
        out = out.union(least.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
    return out
