import datetime as dt

import pytest
from pyspark.sql import functions as F

from voxledger.functions import display as D
from voxledger.functions import text as X
from voxledger.functions import timeparse as P
from voxledger.functions.numeric import half_even
from voxledger.operators.filters import drop_noise


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [row.r for row in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_clean_text(spark):
    cases = {
        None: "",
        "": "",
        "  <b>Hi</b>\n there <br/>": "Hi there",
        "see https://example.com/a?b=1 or www.x.org/y, ok": "see or ok",
        "angry \U0001f621\U0001f644 ❤ flag \U0001f1eb\U0001f1f7 end": "angry flag end",
        "a b c\x1cd　e": "a b c d e",
        "link http://x.y next": "link next",
        "KEEP case! @user &amp; 3 < 4": "KEEP case! @user &amp; 3 < 4",
        "<>kept <unclosed": "<>kept <unclosed",
        " \t ": "",
    }
    assert apply(spark, cases, X.clean_text) == list(cases.values())


def test_post_body(spark):
    wrap = "<!-- SC_OFF -->{}<!-- SC_ON --> submitted by /u/x [link]".format
    cases = {
        wrap("<ul><li>Salt &amp; pepper</li><li>5 &lt; 6</li></ul>"): "Salt & pepper 5 < 6",
        wrap("no entities <b>here</b>"): "no entities here",
        wrap("one\n<p>two&#32;three&nbsp;four</p>"): "one two three four",
        wrap("see [LINK] here [Comments]\nSubmitted By someone else\nlast"): "see here last",
        wrap(""): "",
        "<p>no markers</p>": "",
        None: "",
    }
    assert apply(spark, cases, X.post_body) == list(cases.values())


def test_identifiers_and_titles(spark):
    assert apply(spark, ["t3_abc", "http://x/y/t3_q", "a/", None], X.external_id) == [
        "reddit_abc", "reddit_q", "reddit_", "reddit_",
    ]
    assert apply(spark, ["body", "", None], lambda b: X.merge_title_body(F.lit(" T "), b)) == ["T - body", "T", "T"]
    assert apply(spark, ["\U0001f621\U0001f621abc"], lambda v: X.truncate(v, 2)) == ["\U0001f621\U0001f621"]


def test_iso_timestamps(spark):
    good = {
        "2026-09-28T12:00:00+00:00": dt.datetime(2026, 9, 28, 12),
        "2026-09-28T12:00:00Z": dt.datetime(2026, 9, 28, 12),
        "2026-09-28 17:30:00.250000+05:30": dt.datetime(2026, 9, 28, 12, 0, 0, 250000),
        "2026-09-28": dt.datetime(2026, 9, 28),
        "2026-09-28T12:00": dt.datetime(2026, 9, 28, 12),
    }
    assert apply(spark, good, lambda v: P.try_parse_iso(v).cast("timestamp_ntz")) == list(good.values())
    bad = ["", "2026", "soon", "2026-13-01", "2026-09-28T25:00:00", None]
    assert apply(spark, bad, P.try_parse_iso) == [None] * len(bad)
    now = F.lit("2030-01-01").cast("timestamp")
    assert apply(spark, ["soon"], lambda v: P.parse_iso(v, now).cast("timestamp_ntz")) == [dt.datetime(2030, 1, 1)]
    assert apply(spark, [1727500000.5, 1727500000.0], lambda v: P.iso_utc(P.from_epoch_seconds(v)), "double") == [
        "2024-09-28T05:06:40.500000+00:00", "2024-09-28T05:06:40+00:00",
    ]


def test_noise_filter(spark):
    raws = [
        "two words", "now three words", "!! ... ??? one two", "@a @b @c @d @e still fine here",
        "@a @b @c @d @e @f too many here", "https://example.com/only", "a1 b2 çé", "",
    ]
    df = spark.createDataFrame([(i, raw) for i, raw in enumerate(raws)], "i int, raw_text string")
    kept = drop_noise(df.withColumn("clean_text", X.clean_text(F.col("raw_text"))))
    assert sorted(row.i for row in kept.collect()) == [1, 3, 6]


def test_display_values(spark):
    sources = ["tweet", "app_review", "in_app_chat", None]
    assert apply(spark, sources, lambda s: D.source_label(s, "chart")) == ["Twitter / X", "App Store", "In App Chat", None]
    assert apply(spark, sources, D.source_label) == ["Twitter", "App Store", "In App Chat", None]
    assert apply(spark, sources, lambda s: D.source_label(s, "backlog")) == ["Twitter", "App Store", "in_app_chat", None]
    assert apply(spark, [7, 1234], D.ticket_id, "bigint") == ["TIQ-007", "TIQ-1234"]
    assert apply(spark, [12.5, 0.0, -3.0, None], D.delta_text, "double") == ["+12.5%", "+0.0%", "-3.0%", None]
    answers = {' "Login loop on iOS" ': "Login loop on iOS", '""': "F", "": "F", "x" * 100: "F", "x" * 99: "x" * 99, None: "F"}
    assert apply(spark, answers, lambda a: D.accept_title(a, F.lit("F"))) == list(answers.values())
    assert apply(spark, [0.25, 2.25, 2.35, -0.25], lambda v: half_even(v, 1), "double") == pytest.approx([0.2, 2.2, 2.4, -0.2])
