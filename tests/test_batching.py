"""Batches in id order: repeated and missing ids, and where the work lies."""

from collections import Counter

import pytest

from voxledger.functions.numeric import row_hash
from voxledger.operators import batching
from voxledger.operators import enrichment as E


def batches(df, size=15):
    found = {}
    for row in E.micro_batches(df, size).collect():
        found.setdefault(row.batch_id, []).append(row)
    return {b: sorted(rows, key=lambda r: r.pos) for b, rows in found.items()}


@pytest.fixture()
def many_chunks(monkeypatch):
    monkeypatch.setattr(batching, "CHUNKS_PER_TASK", 20)


def check(df, size, whole=True):
    found = batches(df, size)
    rows = [(r.id, r.clean_text) for b in sorted(found) for r in found[b]]
    assert Counter(rows) == Counter((r.id, r.clean_text) for r in df.collect())
    ids = [i for i, _ in rows]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    assert sorted(found) == list(range(len(found)))
    assert all([r.pos for r in held] == list(range(len(held))) and len(held) <= size for held in found.values())
    if whole:
        assert all(len(found[b]) == size for b in sorted(found)[:-1])
    return found


def test_distinct_ids(spark, many_chunks):
    ids = [i * i - 5000 for i in range(997)]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "id bigint, clean_text string").repartition(6)
    found = check(df, 4)
    assert len({r.chunk for rows in found.values() for r in rows}) > 50
    assert all(len({r.chunk for r in rows}) == 1 for rows in found.values())


def test_a_third_of_all_rows_share_an_id_and_a_third_have_none(spark, many_chunks):
    rows = [(7, f"same id {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, clean_text string").repartition(5)
    found = check(df, 4)
    chunks = Counter(r.chunk for held in found.values() for r in held)
    assert max(chunks.values()) <= 16


def test_equal_rows_stay_together_and_none_is_lost(spark, many_chunks):
    rows = [(1, "copy")] * 200 + [(None, "void")] * 150 + [(i, "x") for i in range(50)]
    check(spark.createDataFrame(rows, "id bigint, clean_text string").repartition(3), 4, whole=False)


def test_one_shuffle_of_the_rows(spark):
    df = spark.createDataFrame([(i, f"t {i}") for i in range(40)], "id bigint, clean_text string")
    batched = E.with_item_number(E.micro_batches(df))
    prompts = E.build_batch_prompts(batched)
    assert prompts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    kept = E.keep_batches(batched)
    plan = E.build_batch_prompts(kept)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_row_answers_never_multiply_rows(spark):
    bug, spam = '{"category": "Bug", "urgency_score": 4}', '{"category": "Spam"}'
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, " "), (4, "e")], "id bigint, clean_text string")
    answers = spark.createDataFrame([(1, bug), (1, bug), (2, spam), (2, bug), (None, bug), (3, bug), (9, bug)], "id bigint, response string")
    found = sorted((str(r.id), r.clean_text, r.category) for r in E.classify_rows(rows, answers).collect())
    assert found == [
        ("1", "a", "Bug"),
        ("1", "b", "Bug"),
        ("2", "c", "Bug"),
        ("3", " ", "Uncategorized"),
        ("4", "e", "Uncategorized"),
        ("None", "d", "Bug"),
    ]


def test_hash_tells_rows_apart(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id bigint, clean_text string")
    assert df.select(row_hash(df)).distinct().count() == 2
