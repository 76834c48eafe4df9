"""The raw contract every channel produces, and choices between channels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.text import strip


def to_contract(df: DataFrame) -> DataFrame:
    """The four contract columns; absent ones become null."""
    columns = [
        (F.col(field.name) if field.name in df.columns else F.lit(None)).cast(field.dataType).alias(field.name)
        for field in S.RAW_CONTRACT
    ]
    return df.select(*columns)


def union_sources(*frames: DataFrame) -> DataFrame:
    """One stream of contract rows out of any number of channels."""
    return reduce(DataFrame.unionByName, [to_contract(frame) for frame in frames])


def first_nonempty_tier(tiers: Sequence[DataFrame], authoritative: DataFrame | None = None) -> DataFrame:
    """Rows of the first tier that has any.

    An authoritative tier (a working authenticated feed) is the answer even
    when it is empty. Tiers are probed in order for a single row, so a tier
    behind the first useful one is never read.
    """
    if authoritative is not None:
        return to_contract(authoritative)
    chosen = next((tier for tier in tiers if not tier.isEmpty()), tiers[-1])
    return to_contract(chosen)


def channel_cap(limit: int, channels: int) -> int:
    """How many posts one channel may contribute."""
    return max(5, min(limit // max(1, channels), 25))


def total_cap(limit: int, low: int = 5, high: int = 100) -> int:
    """How many posts one authenticated request may return."""
    return max(low, min(limit, high))


def per_source_cap(
    df: DataFrame, cap: int, channel: str = "channel", newest: str = "created_at", tie: str = "id"
) -> DataFrame:
    """The newest ``cap`` rows of each channel; every task drops its surplus before the shuffle."""
    order = Window.partitionBy(channel).orderBy(F.desc(newest), tie)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def channel_list(spec: Column) -> Column:
    """``"a+b, c"`` as an array of names; the default list when nothing is named."""
    parts = F.transform(F.split(F.replace(spec, F.lit("+"), F.lit(",")), ","), strip)
    named = F.filter(parts, lambda name: name != "")
    default = F.array(*[F.lit(name) for name in S.DEFAULT_CHANNELS])
    return F.when(F.size(named) > 0, named).otherwise(default)


def parse_channels(spec: str | Sequence[str]) -> list[str]:
    """The same for a parameter on the driver."""
    parts = spec.replace("+", ",").split(",") if isinstance(spec, str) else spec
    return [part.strip() for part in parts if part.strip()] or list(S.DEFAULT_CHANNELS)
