"""Near copies of the pipeline against brute force."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from plain import components

from voxledger.llm import copies
from voxledger.llm.runs import Union


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture
def corpus():
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [*texts, texts[0].upper(), "", None, "one two", "two one"]


def test_stage_links_what_is_alike_by_four_fifths(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    sets = list(map(shingles, corpus))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if similarity(sets[a], sets[b]) >= 0.8]
    assert sum(similarity(sets[a], sets[b]) < 0.9 for a, b in links) > 20
    got = [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()]
    assert sorted(got) == sorted(set(components(range(len(sets)), links).values()))


def test_split_buckets_link_as_whole_ones(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus)), "doc_id bigint, text string")
    want = sorted(r["doc_id"] for r in copies.keep_first(docs, "doc_id", "text").collect())
    monkeypatch.setattr(copies, "BUCKET_ROWS", 2)
    assert sorted(r["doc_id"] for r in copies.keep_first(docs, "doc_id", "text").collect()) == want


def near_docs(spark):
    """A long text, two copies with another last word, and an unrelated one."""
    rng = random.Random(5)
    base, other = ([f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(2))
    texts = [base, [*base[:-1], "changed"], [*base[:-1], "again"], other]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")


def test_trees_alone_link_the_nearest_copies(spark, monkeypatch):
    docs, buckets = near_docs(spark), copies._buckets
    monkeypatch.setattr(copies, "_buckets", lambda nodes, *_: buckets(nodes, *_).limit(0))
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [0, 3]


def test_trees_links_below_the_similarity_are_not_made(spark):
    docs = near_docs(spark)
    kept = copies.keep_first(docs, "doc_id", "text", similarity=0.9999).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 1, 2, 3]


def test_a_joined_group_does_not_meet_itself_again(spark):
    """Each row of a large component goes to the blocks of the others only, so a bucket grows with its rows."""
    rows = [(1, i, 0 if i < 3000 else i) for i in range(3010)]
    buckets = spark.createDataFrame(rows, "bucket bigint, print bigint, component bigint")
    dealt = copies.bucket_blocks(buckets, 100).collect()
    assert len(dealt) <= 3000 + 10 * 31
    sides = {}
    for r in dealt:
        sides.setdefault((r["lo"], r["hi"]), set()).add(r["print"])
    met = {frozenset(p) for prints in sides.values() for p in itertools.combinations(sorted(prints), 2) if max(p) >= 3000}
    assert len(met) == 3000 * 10 + 45


@pytest.mark.parametrize("hi", [0, 1])
def test_groups_that_merge_while_a_row_meets_them(hi):
    """A row may join an earlier group with the group it belonged to before; the links are those of all pairs."""
    first, last = np.arange(10, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64)
    small = [copies.Row(5, first), copies.Row(10, last), copies.Row(11, first)]
    known = Union()
    known.join(11, 10)
    copies.link_bucket(small, [0, 0, hi], 0, hi, 0.8, known)
    assert {known.find(n) for n in (5, 10, 11)} == {5}
    rng = random.Random(7)
    for _ in range(300):
        names = rng.sample(range(-1000, 1000), 14)
        rows = [copies.Row(n, np.arange(k := 10 * rng.randrange(5), k + 10, dtype=np.uint64)) for n in names]
        mine = [rng.randrange(hi + 1) for _ in names]
        joined = [tuple(rng.sample(names, 2)) for _ in range(5)]
        found = Union()
        for a, b in joined:
            found.join(a, b)
        copies.link_bucket(rows, mine, 0, hi, 0.8, found)
        pairs = itertools.combinations(zip(rows, mine, strict=True), 2)
        links = [(a.name, b.name) for (a, i), (b, j) in pairs if (not hi or i != j) and (a.shingles == b.shingles).all()]
        assert {n: found.find(n) for n in names} == components(names, [*joined, *links])
