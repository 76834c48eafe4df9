"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxledger.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) for every id on an edge.

    Alternates large-star and small-star steps until nothing changes, a number of
    rounds logarithmic in the size. A step sends each neighbour to the smallest one,
    found by a partial aggregate and joined back, so a hub with any number of
    neighbours is never gathered. Loops and edges with a null end are ignored;
    repeated edges count once. Each round is written to the shared folder.
    """

    def down(df: DataFrame) -> DataFrame:
        return df.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()

    stars = materialize(down(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "stars")
    mark = _mark(stars)
    while True:
        both = stars.union(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        lowest = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(lowest, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        stars = materialize(down(moved.union(lowest.select("x", F.col("m").alias("y")))), "stars")
        new = _mark(stars)
        if new == mark:
            break
        mark = new
    return stars.select(F.col("x").alias("id"), F.col("y").alias("component")).union(
        stars.select(F.col("y").alias("id"), F.col("y").alias("component")).distinct()
    )


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], row[1]
