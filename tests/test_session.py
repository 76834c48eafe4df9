"""Intermediate results go when whoever opened ``scratch`` is done with them."""

import os
import random
from urllib.parse import urlparse

import pytest

from voxledger.session import drop_shuffles, materialize, materialize_buckets, scratch, settings, settle


def folder_of(df):
    return os.path.dirname(urlparse(df.inputFiles()[0]).path)


def test_scratch_is_removed_on_leaving(spark):
    outside = materialize(spark.range(3), "outside")
    with scratch(spark):
        inside = materialize(spark.range(5), "inside")
        path = folder_of(inside)
        assert inside.count() == 5
    assert not os.path.exists(path)
    assert outside.count() == 3


def test_scratch_is_removed_after_a_failure(spark):
    with pytest.raises(RuntimeError), scratch(spark):
        path = folder_of(materialize(spark.range(5), "inside"))
        raise RuntimeError
    assert not os.path.exists(path)


def test_settle_keeps_the_result_alone(spark):
    made = []

    def build():
        made.append(materialize(spark.range(5), "step"))
        return made[0].filter("id > 2")

    with scratch(spark):
        got = settle(spark, build, "result")
        assert not os.path.exists(os.path.dirname(urlparse(made[0].inputFiles()[0]).path))
        assert sorted(r["id"] for r in got.collect()) == [3, 4]
        path = folder_of(got)
    assert not os.path.exists(path)


def test_settle_where_nothing_is_made(spark):
    with scratch(spark):
        assert settle(spark, lambda: None, "result") is None


def test_settings_hold_inside_alone(spark):
    key, cleanup = "spark.sql.shuffle.partitions", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key), spark.conf.get(cleanup, None)
    with pytest.raises(RuntimeError), settings(spark, spark__sql__shuffle__partitions="7"), drop_shuffles(spark):
        assert (spark.conf.get(key), spark.conf.get(cleanup)) == ("7", "true")
        raise RuntimeError
    assert (spark.conf.get(key), spark.conf.get(cleanup, None)) == before


def test_alike_columns_share_their_room_and_come_back(spark):
    rng = random.Random(1)
    texts = [None if i % 50 == 7 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5_000)) for i in range(400)]
    rows = [(i, t, None if i % 60 == 5 else t and t[1:], i % 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, raw_text string, clean_text string, k int").coalesce(1)

    def size(kept):
        return sum(os.path.getsize(urlparse(f).path) for f in kept.inputFiles())

    with scratch(spark):
        apart = size(materialize(df, "apart"))
        for kept in (materialize(df, "together", ("raw_text", "clean_text")), materialize_buckets(df, "id", "together", ("raw_text", "clean_text"))):
            assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows
            assert size(kept) < 0.6 * apart
        # Only one of them, or of two types: stored as they are.
        for some in (df.drop("clean_text"), df.withColumn("clean_text", df.id)):
            assert materialize(some, "some", ("raw_text", "clean_text")).dtypes == some.dtypes
