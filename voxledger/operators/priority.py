"""Priority: urgency x category weight x a damped volume of the category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.numeric import half_even, row_hash

KNOWN_CATEGORIES = tuple(S.CATEGORY_WEIGHTS)
# Parts that the rows of one category outside the vocabulary are dealt to.
SALTS = 64


def category_volume(df: DataFrame) -> DataFrame:
    """Rows per category (null is no category)."""
    return df.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("volume"))


def _pairs(values: dict[str, Column]) -> Column:
    return F.create_map(*[part for key, value in values.items() for part in (F.lit(key), value)])


def category_weight(category: Column) -> Column:
    weights = _pairs({key: F.lit(value) for key, value in S.CATEGORY_WEIGHTS.items()})
    return F.coalesce(F.try_element_at(weights, category), F.lit(S.OTHER_CATEGORY_WEIGHT))


def with_category_volume(df: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Attach the category's row count in ``full`` (by default ``df`` itself).

    Rows of known categories are not shuffled. The six known counts are one global aggregate with one output row, looked
    up as a subquery value, so a category holding a third of the table costs
    nothing extra. Rows of any other category take a join with their
    own counts, salted so that one such category may be hot; on a Parquet table the dictionary of ``category`` lets that
    branch skip every row group without such rows.
    """
    category = F.col("category")
    full = df if full is None else full
    counters = [F.count_if(category == name).alias(f"n{i}") for i, name in enumerate(KNOWN_CATEGORIES)]
    counts = full.agg(*counters).select(
        _pairs({name: F.col(f"n{i}") for i, name in enumerate(KNOWN_CATEGORIES)}).alias("volumes")
    )
    known = df.filter(category.isin(*KNOWN_CATEGORIES) | category.isNull()).withColumn(
        "category_volume", F.coalesce(F.try_element_at(counts.scalar(), category), F.lit(1).cast("bigint"))
    )
    unknown = ~category.isin(*KNOWN_CATEGORIES)
    other = df.filter(unknown)
    volumes = category_volume(full.filter(unknown)).withColumnRenamed("volume", "category_volume")
    salted = volumes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = other.withColumn("_salt", F.pmod(row_hash(df), F.lit(SALTS)).cast("int"))
    return known.unionByName(dealt.join(salted, ["category", "_salt"]).select(known.columns))


def priority(urgency: Column, category: Column, volume: Column) -> Column:
    damped = F.lit(1) + F.sqrt(volume.cast("double")) / F.lit(10)
    return half_even(urgency * category_weight(category) * damped, 2)


def score(df: DataFrame, full: DataFrame | None = None) -> DataFrame:
    """Set ``priority_score``, with volumes of ``full`` (by default ``df`` itself)."""
    value = priority(F.col("urgency_score"), F.col("category"), F.col("category_volume"))
    return with_category_volume(df, full).withColumn("priority_score", value).drop("category_volume")


def rank_feedback(df: DataFrame) -> DataFrame:
    """Highest priority first; ties by id."""
    return score(df).orderBy(F.desc_nulls_last("priority_score"), "id")
