"""What filters remove alone and after each other, from relations of failing ids.

Every filter stores one table of the ids that fail it. All rows are then split, one
table after the other, by a left-semi join (those that fail) and a left-anti join
(those that pass), and likewise by the ids of labelled rows. What is left of a prefix
of filters are the rows that came out of all its anti-joins; what the next filter
removes of them came out of its semi-join. Survivors, removals, redundancies and
label losses of all prefixes are counts over those classes, of which there are at
most 2^(filters + labels) in each part. Joins carry ids alone, never texts.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from voxledger.session import materialize, scratch_folder, ship_by_value

ship_by_value(__name__)

# The filters of single texts by the bit that marks a failure, and the one that compares texts.
TEXT_FILTERS, COPIES = "ABCD", "E"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
KEY = ["doc", "content"]


def text_failures(raw: bytes) -> int:
    """Bits of the filters that a whole text fails: too few words, too few distinct ones, too many capitals, a symbol."""
    words = raw.split()
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    characters = len(raw.translate(None, CONTINUED))
    tests = (
        len(words) < FEWEST_WORDS,
        100 * len(set(words)) < LEAST_DISTINCT * len(words),
        100 * capitals > MOST_CAPITALS * characters,
        SYMBOLS.search(raw) is not None,
    )
    return sum(failed << bit for bit, failed in enumerate(tests))


def failures(text: Column) -> Column:
    """The bits of :func:`text_failures`; a null text is an empty one."""

    @arrow_udf("int")
    def failed(raws: pa.Array) -> pa.Array:
        return pa.array((text_failures(raw.as_py() or b"") for raw in raws), pa.int32())

    return failed(text.cast("binary"))


def judge_documents(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """Narrow rows of all documents, written once: ``doc``, ``content`` (16 bytes of the text's hash), ``part`` and ``failed`` bits.

    Null and empty texts fail as texts without words; a null part is the empty string;
    null ids and repeated rows stay rows; other columns are ignored.
    """
    content = F.substring(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)), 1, 16)
    rows = docs.select(
        F.col(id_col).alias("doc"),
        content.alias("content"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        failures(F.col(text_col)).alias("failed"),
    )
    return materialize(rows, "judged")


def later_copies(judged: DataFrame) -> DataFrame:
    """Ids of rows whose text some smaller id has too. A null id is no smaller one and has no smaller one.

    Only the first id of each text is grouped, in the tasks first; a text that a third of
    all rows share never meets in one place, as the anti-join is by id and text.
    """
    first = judged.groupBy("content").agg(F.min("doc").alias("doc"))
    return judged.filter("doc IS NOT NULL").join(first, KEY, "left_anti").select(*KEY)


def store_failing(judged: DataFrame) -> dict[str, DataFrame]:
    """One table of failing ids for each filter, in a folder of its own below one shared path."""
    spark, path = judged.sparkSession, scratch_folder(judged.sparkSession, "failing")
    fails = F.array_compact(F.array(*(F.when(F.col("failed").bitwiseAND(1 << k) != 0, F.lit(f)) for k, f in enumerate(TEXT_FILTERS))))
    texts = judged.select(*KEY, F.explode(fails).alias("filter"))
    stored = texts.unionByName(later_copies(judged).withColumn("filter", F.lit(COPIES)))
    stored.write.partitionBy("filter").parquet(path)
    shape = StructType([*(judged.schema[c] for c in KEY), StructField("filter", stored.schema["filter"].dataType)])
    tables = spark.read.schema(shape).parquet(path)
    return {f: tables.filter(F.col("filter") == f).select(*KEY) for f in TEXT_FILTERS + COPIES}


def split_rows(rows: DataFrame, key: Sequence[str], ids: DataFrame, name: str) -> DataFrame:
    """The rows with a flag ``name`` that tells whether their key is in ``ids``; nulls in a key match nulls."""
    ours, theirs = rows.alias("ours"), ids.alias("theirs")
    same = [F.col(f"ours.{c}").eqNullSafe(F.col(f"theirs.{c}")) for c in key]
    inside = ours.join(theirs, same, "left_semi").withColumn(name, F.lit(True))
    outside = ours.join(theirs, same, "left_anti").withColumn(name, F.lit(False))
    return materialize(inside.unionByName(outside), f"split-{name}")


def classes(rows: DataFrame, key: Sequence[str], failing: Mapping[str, DataFrame], losses: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """Rows of each part by which filters they fail (``mask``, a bit per filter) and which labels they hold; ``held`` counts them."""
    rows = rows.select(*key, "part")
    for name, ids in failing.items():
        rows = split_rows(rows, key, ids, f"fails_{name}")
    for name, (column, ids) in losses.items():
        rows = split_rows(rows, [column], ids, f"is_{name}")
    mask = sum((F.col(f"fails_{name}").cast("int") * (1 << bit) for bit, name in enumerate(failing)), F.lit(0))
    return rows.groupBy("part", mask.alias("mask"), *(f"is_{name}" for name in losses)).agg(F.count(F.lit(1)).alias("held"))


def audit(rows: DataFrame, key: Sequence[str], failing: Mapping[str, DataFrame], losses: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``rows`` holds the key columns and ``part``; ``failing`` the failing keys of each
    filter; ``losses`` a key column and the ids of each label. Columns: ``part``,
    ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant`` (fail here, removed
    earlier), ``unique_fails`` (fail this filter only), ``<label>_lost`` and ``shapley``
    (removals of the step's filter, summed over all orders). An empty table has no parts
    and gives no rows; a filter without failing ids removes nothing.
    """
    names = list(failing)
    prefixes = [(before, 1 << k) for before in range(1 << len(names)) for k in range(len(names)) if not before >> k & 1]
    orders = [
        ("".join(order), step + 1, sum(1 << names.index(f) for f in order[:step]), 1 << names.index(order[step]))
        for order in itertools.permutations(names)
        for step in range(len(names))
    ]
    weight = {p: math.factorial(p[0].bit_count()) * math.factorial(len(names) - 1 - p[0].bit_count()) for p in prefixes}
    steps = rows.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    cut = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(k).alias("bit"), F.lit(weight[b, k]).alias("orders")) for b, k in prefixes)))
    each = classes(rows, key, failing, losses).withColumn("cut", cut).select("*", "cut.*")
    mask, before, bit = F.col("mask"), F.col("before"), F.col("bit")
    alive, fails = mask.bitwiseAND(before) == 0, mask.bitwiseAND(bit) != 0

    def held(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("held")).otherwise(0)).cast("bigint")

    counted = each.groupBy("part", "before", "bit", "orders").agg(
        held(alive & ~fails).alias("kept"),
        held(alive & fails).alias("removed"),
        held(~alive & fails).alias("redundant"),
        held(mask == bit).alias("unique_fails"),
        *(held(alive & fails & F.col(f"is_{name}")).alias(f"{name}_lost") for name in losses),
    )
    share = F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "bit")).cast("bigint")
    counted = counted.withColumn("shapley", share).drop("orders")
    return counted.join(F.broadcast(steps), ["before", "bit"]).drop("before", "bit")


def label_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Ids that some row labels 1; a null label is none."""
    return labels.filter(F.col(label_col) == 1).select(F.col(id_col).alias("doc")).distinct()


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str, part_col: str, text_col: str, good: str, toxic: str) -> DataFrame:
    """:func:`audit` of the five filters over documents, with losses of good and of toxic ones.

    Rows are told apart by id and text: repeated rows count each, rows that share an id
    fail by their own texts. A null id has no label.
    """
    judged = judge_documents(docs, id_col, part_col, text_col)
    losses = {"good": ("doc", label_ids(labels, id_col, good)), "toxic": ("doc", label_ids(labels, id_col, toxic))}
    losses = {name: (column, ids.filter("doc IS NOT NULL")) for name, (column, ids) in losses.items()}
    return audit(judged, KEY, store_failing(judged), losses)
