"""Leaves that hold many rows are split further, and no link is lost or counted twice by it."""

import numpy as np
from pyspark.sql import functions as F

from voxledger.llm import embedding
from voxledger.session import materialize


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3_000, 32))
    # Near copies of a third of the rows.
    x[1_000:2_000] = x[:1_000] + 0.1 * rng.standard_normal((1_000, 32))
    return x.astype(np.float32)


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(embedding, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(embedding, "LEAF_ROWS", 64)
    monkeypatch.setattr(embedding, "LARGE_ROWS", 200)
    monkeypatch.setattr(embedding, "LARGE_SAMPLE", 200)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vector array<float>")
    classes = materialize(df.withColumn("size", F.size("vector")), "classes")
    whole = materialize(classes.select("node", "size", F.array(F.lit(0).cast("bigint"), F.lit(1 << 40)).alias("leaves")), "placed")
    split = embedding.split_large(classes, whole, 0.9)
    sizes = split.select("node", F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    assert max(r["count"] for r in sizes) <= 200
    assert {r["leaf"] >> 40 for r in sizes} == {0, 1}
    assert split.count() == len(x)

    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    got = embedding.near_duplicates(df, "node", "vector").collect()
    assert len(got) == len(x)
    assert all(r["n_links"] <= hit[r["node"]].sum() for r in got)
    assert sum(r["n_links"] for r in got) >= 0.97 * hit.sum()


def test_a_dense_leaf_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding, "LARGE_ROWS", 100)
    rng = np.random.default_rng(4)
    x = np.ones(16) + 0.05 * rng.standard_normal((400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, vector array<double>")
    got = embedding.near_duplicates(df, "node", "vector").collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "node bigint, vector array<double>")
    assert embedding.near_duplicates(df, "node", "vector").count() == 0
