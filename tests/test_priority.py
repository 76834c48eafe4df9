import random

from helpers import feedback
from pyspark.sql import functions as F

from voxledger.operators.enrichment import micro_batches
from voxledger.operators.ordering import paginate, top_n, with_position, with_rank
from voxledger.operators.priority import with_category_volume
from voxledger.operators.priority import rank_feedback, score


def scores(df):
    return {row.id: row.priority_score for row in score(df).collect()}


def test_empty_input_keeps_the_column(spark):
    scored = score(feedback(spark, []))
    assert "priority_score" in scored.columns and scored.count() == 0


def test_bug_outranks_praise_at_same_urgency(spark):
    found = scores(feedback(spark, [{"category": "Bug"}, {"category": "Praise"}]))
    assert found[0] > found[1]


def test_urgency_orders_within_category(spark):
    found = scores(feedback(spark, [{"urgency": 1}, {"urgency": 5}]))
    assert found[0] < found[1]


def test_rank_is_descending(spark):
    rows = [{"urgency": 1}, {"urgency": 5}, {"category": "Praise"}]
    ranked = [row.priority_score for row in rank_feedback(feedback(spark, rows)).collect()]
    assert ranked == sorted(ranked, reverse=True)


def test_spam_scores_lowest(spark):
    found = scores(feedback(spark, [{"category": "Spam", "urgency": 5}, {"category": "Bug", "urgency": 1}]))
    assert found[0] == 0.0 < found[1]


def test_exact_values_and_categories_outside_the_vocabulary(spark):
    rows = [{"category": "Bug", "urgency": 3}] * 4
    rows += [{"category": "Billing", "urgency": 2}] * 9 + [{"category": None, "urgency": 2}] * 4
    rows += [{"category": "Uncategorized", "urgency": 5}]
    found = scores(feedback(spark, [dict(row) for row in rows]))
    assert len(found) == 18
    assert found[0] == 5.4  # 3 * 1.5 * 1.2
    assert found[4] == 1.3  # 2 * 0.5 * 1.3: its own volume counts
    assert found[13] == 1.1  # no category: volume 1
    assert found[17] == 2.75


def test_partitioning_does_not_matter(spark):
    df = feedback(spark, [{"category": c, "urgency": u} for c in ("Bug", "Odd", "Spam") for u in range(1, 6)])
    assert scores(df.repartition(16)) == scores(df.coalesce(1))


def test_positions_with_sparse_and_negative_ids(spark):
    ids = [-(2**62), -5, 0, 1, 2**20, 2**20 + 1, 2**44, 2**44 + 7, 2**62]
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in ids], "id bigint, key string")
    placed = {row.id: row.position for row in with_position(df, "id").collect()}
    assert [placed[i] for i in sorted(ids)] == list(range(len(ids)))
    keyed = with_position(df, "id", [F.asc("key")]).collect()
    in_order = [row.id for row in sorted(keyed, key=lambda row: row.position)]
    assert in_order == [row[1] for row in sorted(("a" if i % 2 else "b", i) for i in ids)]


def test_rows_without_id_keep_a_position(spark):
    df = spark.createDataFrame([(None, "x"), (3, "y"), (None, "x"), (1, "z"), (None, None)], "id bigint, text string")
    placed = sorted((row.position, row.id) for row in with_position(df, "id").collect())
    assert placed == [(0, 1), (1, 3), (2, None), (3, None), (4, None)]
    assert micro_batches(df.withColumnRenamed("text", "clean_text"), 2).count() == 5


def test_pages_and_ranks(spark):
    scored = score(feedback(spark, [{"category": c, "urgency": u} for c in ("Bug", "Spam") for u in (5, 1, 3, 3, 2)]))
    shallow = [[row.id for row in paginate(scored, page, 4).collect()] for page in (1, 2, 3, 4)]
    in_order = sorted(scored.collect(), key=lambda r: (-r.priority_score, r.id))
    assert sum(shallow, []) == [row.id for row in in_order]
    assert [len(page) for page in shallow] == [4, 4, 2, 0]
    ranks = {row.id: row["rank"] for row in with_rank(scored).collect()}
    assert [ranks[i] for i in shallow[0]] == [0, 1, 2, 3]
    assert top_n(scored, 3).count() == 3


def test_deep_pages_are_cut_out_by_value(spark, monkeypatch):
    from voxledger.operators import ordering

    rng = random.Random(11)
    values = [(rng.choice([8.25, 1.0, 0.5, 1e-9, 7e8, None]), rng.choice([None, *range(-40, 40), 2**62, -(2**62)])) for _ in range(700)]
    scored = spark.createDataFrame(values, "priority_score double, id bigint").repartition(5)
    in_order = sorted(values, key=lambda v: (v[0] is None, -(v[0] or 0), v[1] is not None, v[1] or 0))
    monkeypatch.setattr(ordering, "HEAP_ROWS", 0)
    monkeypatch.setattr(ordering, "BINS", 4)
    for page, limit in ((1, 25), (7, 25), (2, 200), (4, 200), (28, 25), (29, 25), (700, 1), (123, 3)):
        want = in_order[(page - 1) * limit : page * limit]
        assert [tuple(r) for r in paginate(scored, page, limit).collect()] == want


def test_page_a_million_holds_no_heap(spark):
    scored = spark.range(30_000_000).select("id", (F.col("id") % 97).cast("double").alias("priority_score"))
    page = paginate(scored, 1_000_000, 25)
    # Rows 24,999,975 and on by score, then id.
    per_value = [30_000_000 // 97 + (v < 30_000_000 % 97) for v in range(97)]
    value, skipped = 96, 24_999_975
    while skipped >= per_value[value]:
        skipped -= per_value[value]
        value -= 1
    assert [tuple(r) for r in page.collect()] == [((skipped + k) * 97 + value, float(value)) for k in range(25)]


def test_hot_unknown_category_without_numbers(spark):
    df = spark.createDataFrame([("Odd", f"t{i}", "3") for i in range(200)], "category string, clean_text string, note string")
    volumes = with_category_volume(df)
    assert {r.category_volume for r in volumes.collect()} == {200} and volumes.count() == 200
