import datetime as dt
import json
import os
import random
import time

import pytest
from helpers import feedback, hours_ago
from pyspark.sql import functions as F

from voxledger import session
from voxledger.catalog import load
from voxledger.catalog.keyword_answers import keyword_answers
from voxledger.operators.priority import score
from voxledger.plans import backlog as B
from voxledger.plans import ingest
from voxledger.plans.ingest import fetch_run, ingest_run, upsert_run, with_ids
from voxledger.session import files, folders, scratch, settings
from voxledger.sources import contract as C
from voxledger.sources import feedback_table as T
from voxledger.sources import posts as P
from voxledger.sources import watermark as W
from voxledger.sources.driver_tables import feedback_text

FEED = """<feed xmlns="http://www.w3.org/2005/Atom">
  <entry><id>thread/t3_k9x</id><updated>2031-03-02T08:30:00+00:00</updated><title>  Map view goes grey</title>
    <content type="html">&lt;!-- SC_OFF --&gt;Tiles &amp;lt;gone&amp;gt; after &lt;i&gt;zooming&lt;/i&gt;, twice&lt;!-- SC_ON --&gt; [comments]</content></entry>
  <entry><title>Dark mode please</title><id>t3_m2</id><updated>2031-03-02T07:30:00+00:00</updated></entry>
  <entry><id>t3_untitled</id><updated>2031-03-02T09:00:00+00:00</updated></entry>
  <entry><id>t3_undated</id><title>When was this?</title><updated>some day</updated></entry>
</feed>"""
HALF_PAST_SEVEN = 1930203000.0
ELEVEN = 1790593200.0


def feeds(spark, *documents):
    return spark.createDataFrame([(d,) for d in documents], "xml string")


def test_atom_feed(spark):
    rows = {row.external_id: row for row in P.parse_atom_feed(feeds(spark, FEED, "<broken", "")).collect()}
    assert set(rows) == {"reddit_k9x", "reddit_m2", "reddit_undated"}
    assert rows["reddit_k9x"].raw_text == "Map view goes grey - Tiles <gone> after zooming , twice"
    assert rows["reddit_k9x"].created_at == "2031-03-02T08:30:00+00:00"
    assert rows["reddit_m2"].raw_text == "Dark mode please"
    assert rows["reddit_undated"].posted_at > dt.datetime(2026, 1, 1)


def test_a_post_at_the_mark_is_not_new(spark):
    dated = FEED[: FEED.index("  <entry><id>t3_untitled")] + "</feed>"
    kept = P.parse_atom_feed(feeds(spark, dated), since=HALF_PAST_SEVEN)
    assert [row.external_id for row in kept.collect()] == ["reddit_k9x"]
    assert P.newest_mark(kept, HALF_PAST_SEVEN).first().since_utc == HALF_PAST_SEVEN + 3600
    assert P.newest_mark(kept.limit(0), HALF_PAST_SEVEN).first().since_utc == HALF_PAST_SEVEN
    assert P.newest_mark(kept.limit(0)).first().since_utc is None
    assert P.parse_atom_feed(feeds(spark, dated), since=0).count() == 2


def test_seed_posts(spark, tmp_path):
    items = [
        {"source": "reddit", "external_id": "a", "raw_text": "one", "created_at": "2026-09-28T12:00:00+00:00"},
        {"raw_text": "two", "created_at": "2026-09-28T12:05:00.500000+00:00"},
        {"external_id": "c", "created_at": "2026-09-28T10:00:00+00:00"},
        {"external_id": "d", "raw_text": "beyond the limit", "created_at": "2026-09-28T13:00:00+00:00"},
    ]
    (tmp_path / "seed.json").write_text(json.dumps(items, indent=2))
    rows = P.read_seed_posts(spark, str(tmp_path / "seed.json"), limit=3).collect()
    assert [(r.external_id, r.raw_text) for r in rows] == [("a", "one"), ("reddit_1790597100", "two"), ("c", "")]
    late = P.read_seed_posts(spark, str(tmp_path / "seed.json"), limit=3, since=ELEVEN).collect()
    assert [r.external_id for r in late] == ["a", "reddit_1790597100"]


def test_seed_lists_share_a_file(spark, tmp_path):
    lists = [[{"external_id": f"{k}-{i}", "raw_text": f"text\x1e\n{i}", "created_at": "2026-09-28T12:00:00+00:00"} for i in range(k + 1)] for k in range(4)]
    (tmp_path / "seed.json").write_text("\x1e".join(json.dumps(posts, indent=2) for posts in lists))
    rows = P.read_seed_posts(spark, str(tmp_path), limit=2).collect()
    want = [(f"{k}-{i}", f"text\x1e\n{i}") for k in range(4) for i in range(min(2, k + 1))]
    assert sorted((r.external_id, r.raw_text) for r in rows) == want


def test_seed_query_writes_no_file_per_list(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from voxledger.catalog import sources

    path = str(tmp_path / "seed")
    monkeypatch.setattr(sources, "scratch_path", lambda *_: path)
    docs = [(i, f"text {i}", "en", "s", 6) for i in range(2000)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert __spark_entry__.queries()["read_seed_posts"](spark, str(tmp_path)).count() == 2 * (50 * 25 - 21)
    # 100 lists.
    assert sum(name.endswith(".txt") for _, _, names in os.walk(path) for name in names) < 30

def test_loads_keep_equal_texts_together(spark, tmp_path):
    """Texts as they come, and not in order of time: sorted apart they take five times the room."""
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(200)]
    rows = [(i, texts[i // 5], texts[i // 5], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * 389 % 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, raw_text string, clean_text string, created_at timestamp_ntz").coalesce(1)

    def size(path):
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet"))

    T.create_feedback_table(spark, "loads_room", str(tmp_path / "t"))
    try:
        T.load_append(df, "loads_room")
        assert size(T.current_path(spark, str(tmp_path / "t"))) < 15e6
        T.load_overwrite(df, "loads_room")
        assert size(T.current_path(spark, str(tmp_path / "t"))) < 15e6
        assert spark.table("loads_room").count() == 1000
    finally:
        spark.sql("DROP TABLE loads_room")


def documents_and_events(spark, root):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.lit(1).cast("bigint")}).write.parquet(f"{root}/documents.parquet")
    kind = F.element_at(F.array(F.lit("error"), F.lit("click"), F.lit("view")), (F.col("id") % 3 + 1).cast("int"))
    events = spark.range(300).select(
        F.col("id").alias("event_id"), F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        kind.alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    events.write.parquet(f"{root}/events.parquet")


def test_texts_are_shuffled_once_however_often_they_are_loaded(spark, tmp_path):
    documents_and_events(spark, tmp_path)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), scratch(spark):
        rows = feedback_text(spark, str(tmp_path))
        for used in (rows, rows.filter("category = 'Bug'")):
            plan = used._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1, plan
        assert rows.count() == 300 and {r.raw_text for r in rows.collect()} == {f"text {i}" for i in range(60)}


@pytest.fixture
def own_shared(tmp_path, monkeypatch):
    folder = str(tmp_path / "shared")
    os.makedirs(folder)
    monkeypatch.setattr(session, "shared_dir", lambda spark: folder)
    return folder


@pytest.mark.parametrize("name", ["scan_feedback", "create_feedback_table", "load_overwrite", "load_append", "upsert_new_only"])
def test_loads_leave_their_table_alone(spark, tmp_path, own_shared, name):
    """Neither what was written on the way to the table stays, nor shuffle files."""
    documents_and_events(spark, tmp_path)
    shuffles = shuffle_files(spark)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        found = load().queries[name](spark, str(tmp_path))
    left = os.listdir(own_shared)
    assert len(left) == 1 and left[0].startswith(("voxledger-feedback-", "voxledger-scan-")), left
    if name != "upsert_new_only":  # it also counts, which is no write
        wait_until(lambda: shuffle_files(spark) <= shuffles)
    assert found.count() > 0


def shuffle_files(spark):
    """Those of the session's own block managers."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def wait_until(true):
    for _ in range(50):
        if true():
            return
        time.sleep(0.1)
    raise AssertionError("it never came true")


@pytest.mark.parametrize("repeats", [1, 2, 20])
def test_new_rows_by_the_fewer_ids(spark, repeats):
    """Rows chosen by the ids to take or to leave, against a plain version."""
    rng = random.Random(repeats)
    rows = [(f"e{rng.randrange(60) if k < repeats else 100 + k}" if k % 7 else None, rng.randrange(5), k) for k in range(60)]
    stored = spark.createDataFrame([(f"e{k}",) for k in (*range(0, 60, 3), 101, 102, 102, 999)], "external_id string")
    got = T.new_rows(spark.createDataFrame(rows, "external_id string, id bigint, k bigint"), stored).collect()
    known = {r["external_id"] for r in stored.collect()}
    least = {}
    for e, i, _ in rows:
        if e is not None and e not in known:
            least[e] = min(i, least.get(e, i))
    assert sorted(r["k"] for r in got if r["external_id"] is None) == [k for e, _, k in rows if e is None]
    assert {r["external_id"]: r["id"] for r in got if r["external_id"] is not None} == least
    assert len(got) == len(least) + sum(e is None for e, _, _ in rows)


def test_new_rows_of_a_new_delivery_stay_in_place(spark):
    delivery = spark.range(1000).select("id", F.concat(F.lit("e"), "id").alias("external_id"), F.lit("text").alias("raw_text"))
    plan = T.new_rows(delivery, delivery.limit(0))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Inner" not in plan and "LeftSemi" not in plan


def test_few_ids_are_sent_to_the_rows(spark, tmp_path):
    """Where nearly all rows are new, they are not shuffled by id, whatever Spark makes of the size of the ids."""
    rows = spark.range(1000).select("id", F.concat(F.lit("e"), F.greatest("id", F.lit(3))).alias("external_id"), F.lit("text").alias("raw_text"))
    rows.write.parquet(f"{tmp_path}/rows")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        taken = T.new_rows(spark.read.parquet(f"{tmp_path}/rows"), spark.createDataFrame([("e7",)], "external_id string"))
        plan = taken._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hash" not in plan, plan
        assert sorted(r["id"] for r in taken.collect()) == [0, *(i for i in range(4, 1000) if i != 7)]


def test_upsert_picks_rows_before_texts_are_joined(spark, tmp_path, monkeypatch):
    spark.range(10).select(F.col("id").alias("doc"), F.lit("text").alias("raw_text")).write.parquet(f"{tmp_path}/texts")
    third = F.floor(F.col("id") / 3).cast("string")
    ids = spark.range(900).select("id", (F.col("id") % 10).alias("doc"), F.lit("Bug").alias("category"))
    ids = ids.withColumn("external_id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("e"), third)))
    rows = ids.join(spark.read.parquet(f"{tmp_path}/texts"), "doc").drop("doc").filter("category = 'Bug'")
    spark.createDataFrame([], "external_id string").createOrReplaceTempView("nothing_stored")
    chosen = []
    monkeypatch.setattr(T, "load_append", lambda df, table: chosen.append(df))
    T.upsert_new_only(rows, "nothing_stored")
    plan = chosen[0]._jdf.queryExecution().optimizedPlan().toString()
    depth = {kind: min(line.index(kind) for line in plan.split("\n") if kind in line) for kind in ("Join Inner", "Join LeftSemi")}
    assert depth["Join LeftSemi"] > depth["Join Inner"], plan
    assert chosen[0].count() == 300 + 82


def test_submissions(spark):
    posts = spark.createDataFrame(
        [
            ("a", " Title ", " body ", ELEVEN + 0.25, False),
            ("b", "Title", None, ELEVEN + 60, False),
            ("c", "Title", "pinned", ELEVEN + 60, True),
            ("d", "Title", " ", ELEVEN + 60, None),
            ("e", "Title", "", ELEVEN, False),
        ],
        "id string, title string, selftext string, created_utc double, stickied boolean",
    )
    rows = {r.external_id: r for r in P.normalize_submissions(posts, since=ELEVEN).collect()}
    assert {key: r.raw_text for key, r in rows.items()} == {
        "reddit_a": "Title - body", "reddit_b": "Title", "reddit_d": "Title - ",
    }
    assert rows["reddit_a"].created_at == "2026-09-28T11:00:00.250000+00:00"


def test_channel_choices(spark):
    assert C.parse_channels("a+b, c,,") == ["a", "b", "c"] and C.parse_channels(" , ") == ["swiggy"]
    assert C.parse_channels(["x ", ""]) == ["x"]
    assert [C.channel_cap(limit, n) for limit, n in ((25, 2), (25, 20), (500, 1), (25, 0))] == [12, 5, 25, 25]
    assert [C.total_cap(limit) for limit in (1, 50, 900)] == [5, 50, 100] and C.total_cap(1, 10) == 10
    posts = spark.createDataFrame(
        [(i, "hot" if i % 3 else "cold", i // 2) for i in range(60)], "id bigint, channel string, created_at bigint"
    )
    kept = C.per_source_cap(posts, 5).collect()
    hot = sorted(((-r.created_at, r.id) for r in kept if r.channel == "hot"))
    assert hot == sorted((-(i // 2), i) for i in range(60) if i % 3)[:5] and len(kept) == 10


def test_first_tier_with_rows(spark):
    empty = spark.createDataFrame([], "source string, raw_text string")
    second = spark.createDataFrame([("s", "second")], "source string, raw_text string")
    third = spark.createDataFrame([("s", "third")], "source string, raw_text string")
    assert C.first_nonempty_tier([empty, second, third]).first().raw_text == "second"
    assert C.first_nonempty_tier([empty, empty]).count() == 0
    assert C.first_nonempty_tier([second], authoritative=empty).count() == 0
    assert C.union_sources(empty, second, third).columns == ["source", "external_id", "raw_text", "created_at"]


def test_watermark_round_trip(spark, tmp_path):
    path = str(tmp_path / "mark")
    assert W.read_mark(spark, path) is None
    for value in (None, 0.0):
        W.save_mark(spark.createDataFrame([(value,)], "since_utc double"), path)
    assert W.read_mark(spark, path) is None
    W.save_mark(spark.createDataFrame([(1727500000.5,)], "since_utc double"), path)
    assert W.read_mark(spark, path) == 1727500000.5
    W.save_mark(spark.createDataFrame([(1700000000.0,)], "since_utc double"), path)
    assert W.read_mark(spark, path) == 1700000000.0


def stored(spark, name):
    spark.catalog.refreshTable(name)
    return spark.table(name)


@pytest.fixture
def table(spark, tmp_path):
    T.create_feedback_table(spark, "feedback_under_test", str(tmp_path / "table"))
    yield "feedback_under_test"
    spark.sql("DROP TABLE feedback_under_test")


def test_load_and_upsert(spark, table, tmp_path):
    df = feedback(spark, [hours_ago(i) for i in range(4)])
    T.load_append(df, table)
    T.create_feedback_table(spark, table)
    T.load_append(df, table)
    assert stored(spark, table).count() == 8
    T.load_overwrite(df.limit(3), table)
    assert stored(spark, table).count() == 3 and stored(spark, table).first().priority_score == 0.0
    root = str(tmp_path / "table")
    assert T.scan_feedback(spark, root).count() == 3
    for n in (2, 1):
        T.load_overwrite(stored(spark, table).limit(n), table)
        assert T.scan_feedback(spark, root).count() == stored(spark, table).count() == n
    assert [name[:17] for name in folders(spark, root) if name != "_commits"] == ["version-000000002", "version-000000003"]
    assert folders(spark, f"{root}/_commits") == ["000000002", "000000003"] and not files(spark, root)

    def delivery(*ids):
        rows = [(100 + i, key, f"t{i}") for i, key in enumerate(ids)]
        return spark.createDataFrame(rows, "id bigint, external_id string, raw_text string")

    T.upsert_new_only(delivery("a", "b", "a", None), table)
    T.upsert_new_only(delivery("b", "c", None), table)
    found = stored(spark, table).filter("id >= 100").collect()
    assert sorted((str(r.external_id), r.raw_text) for r in found) == [
        ("None", "t2"), ("None", "t3"), ("a", "t0"), ("b", "t1"), ("c", "t1"),
    ]


def test_upsert_picks_one_of_equal_rows_and_moves_no_text(spark, table):
    rows = [(1, "a", "first"), (1, "a", "first"), (2, "a", "later"), (3, "b", "one"), (3, "b", "two"), (4, None, "x"), (4, None, "x")]
    rows += [(5 + i, "hot", f"copy {i}") for i in range(200)]
    incoming = spark.createDataFrame(rows, "id bigint, external_id string, raw_text string")
    before = stored(spark, table).count()
    T.upsert_new_only(incoming, table)
    found = sorted((str(r.external_id), r.raw_text) for r in stored(spark, table).collect())
    assert len(found) - before == 5
    assert [t for e, t in found if e in ("a", "hot")] == ["first", "copy 0"] and sum(e == "None" for e, _ in found) == 2
    plan = T.new_rows(T.to_feedback(incoming), stored(spark, table))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan
    T.upsert_new_only(incoming.filter("external_id IS NOT NULL"), table)
    assert stored(spark, table).count() == len(found)


class Killed(RuntimeError):
    pass


def killed(*_):
    raise Killed


def test_overwrite_that_dies_before_the_commit_changes_nothing(spark, table, tmp_path, monkeypatch):
    root, df = str(tmp_path / "table"), feedback(spark, [hours_ago(i) for i in range(4)])
    T.load_overwrite(df, table)
    monkeypatch.setattr(T, "commit", killed)
    with pytest.raises(Killed):
        T.load_overwrite(df.limit(1), table)
    monkeypatch.undo()
    assert T.scan_feedback(spark, root).count() == stored(spark, table).count() == 4
    T.load_overwrite(df.limit(2), table)
    assert T.scan_feedback(spark, root).count() == stored(spark, table).count() == 2


def test_overwrite_that_dies_after_the_commit_is_found_by_name_and_path(spark, table, tmp_path, monkeypatch):
    root, df = str(tmp_path / "table"), feedback(spark, [hours_ago(i) for i in range(4)])
    T.load_overwrite(df, table)
    real, calls = T.point_to_current, []

    def once(*args):
        calls.append(args)
        return real(*args) if len(calls) == 1 else killed()

    monkeypatch.setattr(T, "point_to_current", once)
    with pytest.raises(Killed):
        T.load_overwrite(df.limit(1), table)
    monkeypatch.undo()
    assert T.scan_feedback(spark, root).count() == 1
    T.load_append(df.limit(2), table)
    assert T.scan_feedback(spark, root).count() == stored(spark, table).count() == 3


def test_of_two_overwrites_at_once_the_second_fails(spark, table, tmp_path, monkeypatch):
    root, df = str(tmp_path / "table"), feedback(spark, [hours_ago(i) for i in range(4)])
    real = T.commit

    def overtaken(*args):
        monkeypatch.setattr(T, "commit", real)
        T.load_overwrite(df.limit(3), table)
        real(*args)

    monkeypatch.setattr(T, "commit", overtaken)
    with pytest.raises(RuntimeError, match="another job"):
        T.load_overwrite(df.limit(1), table)
    assert T.scan_feedback(spark, root).count() == stored(spark, table).count() == 3


def test_marks_are_ordered_by_number_and_compacted(spark, tmp_path):
    path = str(tmp_path / "mark")
    for value in (5.0, 9.0, 3.0, None, 4.0):
        W.save_mark(spark.createDataFrame([(value,)], "since_utc double"), path)
    assert W.read_mark(spark, path) == 4.0
    assert folders(spark, path) == ["mark-000000000003", "mark-000000000004"]


def test_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    texts = ['say "hi"', "two\nlines", "comma, semi;", "back\\slash", "", " padded ", "ü \U0001f621"]
    rows = spark.createDataFrame([("s", t, "2026-01-01T00:00:00") for t in texts], "source string, raw_text string, created_at string")
    T.write_raw_csv(rows, str(tmp_path / "csv"))
    back = T.read_csv(spark, str(tmp_path / "csv"), "source string, raw_text string, created_at string")
    assert sorted(r.raw_text for r in back.collect()) == sorted(texts)


def test_export(spark, tmp_path):
    with pytest.raises(LookupError):
        B.export_backlog_csv(feedback(spark, []), str(tmp_path / "none"))
    df = feedback(spark, [hours_ago(i, urgency=1 + i % 5, source="tweet" if i % 2 else "app_review") for i in range(9)])
    B.export_backlog_csv(df, str(tmp_path / "out"), single_file=True, source="tweet")
    (part,) = (tmp_path / "out").glob("*.csv")
    lines = part.read_text().splitlines()
    assert lines[0].replace('"', "") == "priority_score,category,sentiment,urgency_score,source,clean_text,created_at"
    assert len(lines) == 5
    first = [float(line.split(",")[0].strip('"')) for line in lines[1:]]
    assert first == sorted(first, reverse=True)


def test_backlog_page(spark):
    df = feedback(spark, [hours_ago(i, urgency=1 + i % 5, source="tweet") for i in range(30)])
    page = B.backlog(df, page=2, limit=7, source="tweet", hours=20, search="CHECKOUT").collect()
    assert len(page) == 7 and {(r.total, r.total_pages, r.source) for r in page} == {(21, 3, "Twitter")}
    ranked = [r.id for r in score(df).orderBy("priority_score", ascending=False).collect()]
    assert len(ranked) == 30
    (past,) = B.backlog(df, page=9, limit=7).collect()
    assert (past.id, past.total, past.total_pages, past.page) == (None, 30, 5, 9)
    scores = {r.id: r.priority_score for r in score(df).collect()}
    assert all(r.priority_score == scores[r.id] for r in page)  # volume of all 30 rows, not of the match
    odd = feedback(spark, [hours_ago(i, category="Billing", urgency=2, sentiment="Neutral" if i else "Negative") for i in range(9)])
    assert [r.priority_score for r in B.backlog(odd, sentiment="Negative").collect()] == [1.3]
    with pytest.raises(ValueError):
        B.backlog(df, limit=201)


def test_ingest_run(spark, table):
    raw = spark.createDataFrame(
        [
            (1, "tweet", "App <b>crash</b> \U0001f621 https://x.y", "2026-01-01T00:00:00+00:00"),
            (2, "tweet", "love it", "2026-01-01T01:00:00+02:00"),
            (3, "tweet", " ", "2026-01-01T00:00:00+00:00"),
        ],
        "id bigint, source string, raw_text string, created_at string",
    )
    assert not ingest_run(raw.limit(0), keyword_answers, table)
    assert ingest_run(raw, keyword_answers, table)
    found = {r.id: r for r in stored(spark, table).collect()}
    assert (found[1].clean_text, found[1].category, found[1].urgency_score) == ("App crash", "Bug", 5)
    assert found[1].priority_score == 8.25 and found[2].category == "Praise"
    assert found[2].created_at == dt.datetime(2025, 12, 31, 23)
    assert (found[3].category, found[3].clean_text) == ("Uncategorized", "")
    assert ingest_run(raw, keyword_answers, table, append=True)
    assert stored(spark, table).count() == 6


def test_nulls_take_the_defaults(spark):
    rows = spark.createDataFrame([(1, None, None, None)], "id bigint, category string, raw_text string, urgency_score int")
    (row,) = T.to_feedback(rows).collect()
    assert (row.category, row.raw_text, row.urgency_score, row.sentiment) == ("Uncategorized", "", 1, "Neutral")
    assert row.source == "" and row.created_at > dt.datetime(2026, 1, 1)


def counting(asked):
    def scorer(prompts):
        asked.append(prompts.agg({"item_count": "sum"}).first()[0] or 0)
        return keyword_answers(prompts)

    return scorer


def test_repeated_deliveries_ask_nothing(spark, table):
    raw = spark.createDataFrame(
        [("tweet", "a", "crash", None), ("tweet", "b", "love", None), ("tweet", "a", "crash again", None)],
        "source string, external_id string, raw_text string, created_at string",
    )
    asked = []
    assert upsert_run(raw, counting(asked), table) and asked == [2]
    assert not upsert_run(raw, counting(asked), table) and asked == [2]
    assert stored(spark, table).count() == 2


def test_upsert_run_leaves_its_table_alone(spark, table, own_shared):
    rows = [("tweet", f"e{i}", "crash" if i % 2 else "love", None) for i in range(200)]
    raw = spark.createDataFrame(rows, "source string, external_id string, raw_text string, created_at string")
    assert upsert_run(raw, keyword_answers, table) and not upsert_run(raw, keyword_answers, table)
    assert ingest_run(raw, keyword_answers, table, append=True)
    assert not os.listdir(own_shared)
    found = stored(spark, table).groupBy("category").count().collect()
    assert sorted(map(tuple, found)) == [("Bug", 200), ("Praise", 200)]


def test_labels_come_to_the_rows(spark, monkeypatch):
    """The texts of a delivery are not shuffled once more for their answers."""
    plans, keep = [], ingest.settle

    def planned(spark, build, *rest):
        def looked():
            df = build()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        return keep(spark, looked, *rest)

    monkeypatch.setattr(ingest, "settle", planned)
    rows = [(i, "tweet", "crash", "crash") for i in range(500)]
    cleaned = spark.createDataFrame(rows, "id bigint, source string, raw_text string, clean_text string")
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"), scratch(spark):
        got = ingest._labelled(spark, lambda: cleaned, keyword_answers, 15)
        assert got.filter("category = 'Bug' AND raw_text = 'crash' AND clean_text = 'crash'").count() == 500
    assert "SortMergeJoin" in plans[0] and plans[0].count("Exchange hash") == 1, plans[0]


def test_fetch_survives_a_crash_before_the_mark(spark, table, tmp_path, monkeypatch):
    posts = spark.createDataFrame(
        [(f"p{i}", "ch", f"Post {i}", "late bus", ELEVEN + i, False) for i in range(40)] + [("q", "other", "x", "", ELEVEN, False)],
        "id string, channel string, title string, selftext string, created_utc double, stickied boolean",
    )
    mark, asked = str(tmp_path / "mark"), []

    def run():
        tiers = [lambda since: P.normalize_submissions(posts.limit(0), since), lambda since: P.normalize_submissions(posts, since)]
        return fetch_run(spark, tiers, counting(asked), table, mark, "ch", 25)

    monkeypatch.setattr("voxledger.plans.ingest.save_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        run()
    assert stored(spark, table).count() == 25 and W.read_mark(spark, mark) is None
    monkeypatch.undo()
    assert run() and W.read_mark(spark, mark) == ELEVEN + 39 and asked == [25]
    assert not run() and stored(spark, table).count() == 25
    ids = [r.id for r in with_ids(C.to_contract(P.normalize_submissions(posts))).collect()]
    assert len(set(ids)) == 41 and min(ids) >= 0
