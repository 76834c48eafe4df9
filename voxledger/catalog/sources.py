"""Readers, writers and the watermark, on rows derived from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.keyword_answers import keyword_answers
from voxledger.catalog.labels import SEEN, keyword_case
from voxledger.catalog.registry import query
from voxledger.catalog.text import body_sql, post_content
from voxledger.functions.timeparse import epoch_seconds
from voxledger.plans.ingest import fetch_run
from voxledger.session import COMPRESSION, drop_shuffles, scratch, scratch_path
from voxledger.sources import contract as C
from voxledger.sources import feedback_table as T
from voxledger.sources import posts as P
from voxledger.sources import watermark as W
from voxledger.sources.driver_tables import feedback, feedback_text, table

START = 1704067200  # 2024-01-01
MID_MONTH = 1705276800.0  # 2024-01-15
FB = f"WITH {Q.CTE_FBT}, fb_rows AS (SELECT * FROM fbt) "
LABEL_COLUMNS = "id, source, raw_text, clean_text, created_at, category, sentiment, urgency_score"

# ISO text of a timestamp as the readers write it: a fraction only when there is one.
ISO = """strftime({t}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({t}) % 1000000 <> 0 THEN strftime({t}, '.%f') ELSE '' END || '+00:00'"""


def _new_table(spark: SparkSession) -> str:
    path = scratch_path(spark, "feedback")
    name = "feedback_" + path[-12:]
    T.create_feedback_table(spark, name, path)
    return name


def _read_and_forget(spark: SparkSession, name: str, columns: str) -> DataFrame:
    """The table's rows; its name leaves the catalog, its files stay."""
    spark.catalog.refreshTable(name)
    stored = spark.table(name).select(*columns.split(", "))
    spark.sql(f"DROP TABLE {name}")
    return stored


@query(
    "scan_feedback",
    f"""WITH {Q.CTE_FBT} SELECT id, source, raw_text, clean_text, created_at, category, sentiment, urgency_score,
    0.0::DOUBLE AS priority_score FROM fbt""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "scan")
    with scratch(spark), drop_shuffles(spark):
        T.to_feedback(feedback_text(spark, sf_dir)).write.parquet(path, compression=COMPRESSION)
    return T.scan_feedback(spark, path).drop("external_id")


@query("create_feedback_table", FB + f"SELECT {LABEL_COLUMNS} FROM fb_rows")
def _(spark, sf_dir):
    name = _new_table(spark)
    with scratch(spark):
        T.load_append(feedback_text(spark, sf_dir), name)
    T.create_feedback_table(spark, name)
    return _read_and_forget(spark, name, LABEL_COLUMNS)


@query("load_overwrite", FB + f"SELECT {LABEL_COLUMNS} FROM fb_rows")
def _(spark, sf_dir):
    name = _new_table(spark)
    with scratch(spark):
        rows = feedback_text(spark, sf_dir)
        T.load_append(rows.withColumn("category", F.lit("Spam")), name)
        T.load_overwrite(rows, name)
    return _read_and_forget(spark, name, LABEL_COLUMNS)


@query("load_append", FB + f"SELECT {LABEL_COLUMNS} FROM fb_rows UNION ALL SELECT {LABEL_COLUMNS} FROM fb_rows WHERE category = 'Bug'")
def _(spark, sf_dir):
    name = _new_table(spark)
    with scratch(spark):
        rows = feedback_text(spark, sf_dir)
        T.load_append(rows, name)
        T.load_append(rows.filter("category = 'Bug'"), name)
    return _read_and_forget(spark, name, LABEL_COLUMNS)


@query(
    "upsert_new_only",
    FB + f""", x AS (SELECT *, CASE WHEN id % 11 = 0 THEN NULL ELSE 'e' || (id // 3) END AS external_id FROM fb_rows),
    inc AS (SELECT * FROM x WHERE category IN ('Bug', 'Complaint')),
    s1 AS (SELECT * FROM inc WHERE external_id IS NULL UNION ALL
           SELECT * FROM inc WHERE external_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY id) = 1),
    s2 AS (SELECT * FROM x WHERE external_id IS NULL UNION ALL
           SELECT * FROM x WHERE external_id IS NOT NULL AND external_id NOT IN (SELECT external_id FROM s1 WHERE external_id IS NOT NULL)
           QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY id) = 1)
    SELECT external_id, {LABEL_COLUMNS} FROM s1 UNION ALL SELECT external_id, {LABEL_COLUMNS} FROM s2""",
)
def _(spark, sf_dir):
    third = F.floor(F.col("id") / 3).cast("string")
    # Ids are made before texts are joined, so that the upsert can choose rows without them.
    ids = feedback(spark, sf_dir).withColumn("external_id", F.when(F.col("id") % 11 != 0, F.concat(F.lit("e"), third)))
    name = _new_table(spark)
    with scratch(spark):
        rows = feedback_text(spark, sf_dir, ids)
        T.upsert_new_only(rows.filter("category IN ('Bug', 'Complaint')"), name)
        T.upsert_new_only(rows, name)
    return _read_and_forget(spark, name, "external_id, " + LABEL_COLUMNS)


@query(
    "write_raw_csv",
    """SELECT source, text AS raw_text, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%dT%H:%M:%S') AS created_at
    FROM documents""",
)
def _(spark, sf_dir):
    minutes = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    rows = table(spark, sf_dir, "documents").select(
        "source", F.col("text").alias("raw_text"), F.date_format(minutes, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")
    )
    path = scratch_path(spark, "raw")
    T.write_raw_csv(rows, path)
    return T.read_csv(spark, path, "source string, raw_text string, created_at string")


def _escaped(text):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def landed_feeds(spark, sf_dir):
    """Pages as Atom documents of about 25 entries, and beside them entries without content or without a title."""
    page = F.col("page_id")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=page.cast("int"))
    title = F.concat(F.lit(" Page "), F.regexp_extract("html", "<title>(.*?)</title>", 1))
    entry = F.concat(
        F.lit("<entry><id>"),
        _escaped(F.concat(F.lit("tag/t3_"), page.cast("string"), F.when(~F.col("titled"), "u").when(F.col("full"), "").otherwise("n"))),
        F.lit("</id>"),
        F.when(F.col("titled"), F.concat(F.lit("<title>"), _escaped(title), F.lit("</title>"))).otherwise(""),
        F.lit("<updated>"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        F.lit("</updated>"),
        F.when(F.col("full"), F.concat(F.lit('<content type="html">'), _escaped(post_content()), F.lit("</content>"))).otherwise(""),
        F.lit("</entry>"),
    )
    pages = table(spark, sf_dir, "pages")
    kinds = [(F.lit(True), True, True), (page % 4 == 0, False, True), (page % 10 == 7, True, False)]
    entries = [pages.filter(where).withColumns({"full": F.lit(full), "titled": F.lit(titled)}) for where, full, titled in kinds]
    grouped = reduce(DataFrame.unionByName, entries).groupBy(F.floor(page / 25).alias("feed")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "full", "titled", entry.alias("entry")))).alias("e")
    )
    head = '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>pages</title>'
    return grouped.select("feed", F.concat(F.lit(head), F.array_join("e.entry", ""), F.lit("</feed>")).alias("xml"))


FEED = f"""q AS (SELECT *, TRUE AS whole FROM pages UNION ALL SELECT *, FALSE FROM pages WHERE page_id % 4 = 0),
  p AS (SELECT page_id || CASE WHEN whole THEN '' ELSE 'n' END AS post, page_id,
    'Page ' || trim(regexp_extract(html, '<title>(.*?)</title>', 1)) AS title, CASE WHEN whole THEN {body_sql()} ELSE '' END AS body,
    TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * page_id AS posted_at FROM q)"""


@query(
    "parse_atom_feed",
    f"""WITH {FEED} SELECT 'reddit' AS source, 'reddit_' || post AS external_id,
      CASE WHEN body <> '' THEN title || ' - ' || body ELSE title END AS raw_text,
      strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at FROM p WHERE epoch_us(posted_at) > {START + 1200}::BIGINT * 1000000""",
)
def _(spark, sf_dir):
    return C.to_contract(P.parse_atom_feed(landed_feeds(spark, sf_dir), since=START + 1200.0))


@query(
    "read_seed_posts",
    f"""WITH d AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS posted_at, doc_id % 40 AS pos FROM documents)
    SELECT 'reddit' AS source, CASE WHEN doc_id % 7 = 0 THEN 'reddit_' || epoch_us(posted_at) // 1000000 ELSE 'd' || doc_id END AS external_id,
      text AS raw_text, strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at
    FROM d WHERE pos < 25 AND epoch_us(posted_at) > {START + 1200}::BIGINT * 1000000
    UNION ALL SELECT 'reddit', 'n' || doc_id, '', strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00')
    FROM d WHERE doc_id % 40 < 25 AND epoch_us(posted_at) > {START + 1200}::BIGINT * 1000000""",
)
def _(spark, sf_dir):
    doc = F.col("doc_id")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=doc.cast("int"))
    def lists_of(name, external_id, text):
        post = F.struct(
            F.lit("reddit").alias("source"),
            external_id.alias("external_id"),
            text.alias("raw_text"),
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"),
        )
        named = F.concat(F.lit(name), F.floor(doc / 40).cast("string")).alias("list")
        posts = F.array_sort(F.collect_list(F.struct("doc_id", post.alias("post")))).alias("p")
        return table(spark, sf_dir, "documents").groupBy(named).agg(posts)

    lists = lists_of("whole", F.when(doc % 7 != 0, F.concat(F.lit("d"), doc.cast("string"))), F.col("text")).unionByName(
        lists_of("bare", F.concat(F.lit("n"), doc.cast("string")), F.lit(None).cast("string"))
    )
    path = scratch_path(spark, "seed")
    # Many lists a file: one file each would cost more time than the posts in it.
    lists.select(F.to_json("p.post").alias("value")).write.text(path, lineSep=P.SEED_END)
    return C.to_contract(P.read_seed_posts(spark, path, 25, START + 1200.0))


def landed_submissions(spark, sf_dir):
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p"), doc.cast("string")).alias("id"),
        F.col("source").alias("channel"),
        F.concat(F.lit(" Post in "), F.col("lang")).alias("title"),
        F.col("text").alias("selftext"),
        (F.lit(float(START)) + doc * 37.25).alias("created_utc"),
        (doc % 13 == 0).alias("stickied"),
    )


SUBMISSIONS = f"""posts AS (SELECT 'p' || doc_id AS id, doc_id, source AS channel, coalesce('Post in ' || lang, '') AS title, text AS body, make_timestamp(({START}::BIGINT * 1000000 + doc_id * 37250000)::BIGINT) AS posted_at
    FROM documents WHERE doc_id % 13 <> 0)"""


@query(
    "normalize_submissions",
    f"""WITH {SUBMISSIONS} SELECT 'reddit' AS source, 'reddit_' || id AS external_id,
      CASE WHEN body <> '' THEN title || ' - ' || trim(body, E' \\t\\n\\r') ELSE title END AS raw_text, {ISO.format(t='posted_at')} AS created_at
    FROM posts WHERE epoch_us(posted_at) > {START + 1000}::BIGINT * 1000000
    UNION ALL SELECT 'reddit', 'reddit_n' || id, title, {ISO.format(t='posted_at')}
    FROM posts WHERE epoch_us(posted_at) > {START + 1000}::BIGINT * 1000000""",
)
def _(spark, sf_dir):
    posts = landed_submissions(spark, sf_dir)
    bare = F.when(F.col("created_utc") % 2 < 1, "")
    without = posts.withColumn("id", F.concat(F.lit("n"), F.col("id"))).withColumn("selftext", bare)
    return C.to_contract(P.normalize_submissions(posts.unionByName(without), since=START + 1000.0))


CONTRACT = """SELECT 'app_review' AS source, 'd' || doc_id AS external_id, text AS raw_text, NULL::VARCHAR AS created_at FROM documents
    UNION ALL SELECT 'support_ticket', 'c' || conv_id || '-' || turn, text, NULL FROM conversations WHERE role = 'user'"""


def _reviews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.lit("app_review").alias("source"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("external_id"),
        F.col("text").alias("raw_text"),
        "lang",
    )


def _chats(spark, sf_dir):
    place = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.lit("support_ticket").alias("source"),
        F.concat(F.lit("c"), place).alias("external_id"),
        F.col("text").alias("raw_text"),
    )


@query("union_sources", CONTRACT)
def _(spark, sf_dir):
    return C.union_sources(_reviews(spark, sf_dir), _chats(spark, sf_dir))


@query("first_nonempty_tier", CONTRACT.split("UNION ALL")[1].replace("'support_ticket'", "'support_ticket' AS source", 1)
       .replace("'c' || conv_id || '-' || turn", "'c' || conv_id || '-' || turn AS external_id")
       .replace("text, NULL", "text AS raw_text, NULL::VARCHAR AS created_at"))
def _(spark, sf_dir):
    nothing_new = P.normalize_submissions(landed_submissions(spark, sf_dir), since=4e9)
    return C.first_nonempty_tier([nothing_new, _chats(spark, sf_dir), _reviews(spark, sf_dir)])


@query(
    "per_source_cap",
    """SELECT 'p' || doc_id AS id, source AS channel FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 25""",
)
def _(spark, sf_dir):
    capped = C.per_source_cap(landed_submissions(spark, sf_dir), C.channel_cap(500, 20), "channel", "created_utc")
    return capped.select("id", "channel")


@query(
    "parse_source_list",
    """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '+' || lang WHEN 1 THEN ' ' || source || ' , ,' || lang || ','
        WHEN 2 THEN ' , + ' ELSE '' END AS spec FROM documents),
    n AS (SELECT doc_id, [trim(x) FOR x IN string_split(replace(spec, '+', ','), ',') IF trim(x) <> ''] AS names FROM d)
    SELECT doc_id, CASE WHEN len(names) > 0 THEN array_to_string(names, '|') ELSE 'swiggy' END AS channels FROM n""",
)
def _(spark, sf_dir):
    form = F.col("doc_id") % 4
    spec = (
        F.when(form == 0, F.concat_ws("+", "source", "lang"))
        .when(form == 1, F.concat(F.lit(" "), F.col("source"), F.lit(" , ,"), F.col("lang"), F.lit(",")))
        .when(form == 2, " , + ")
        .otherwise("")
    )
    names = C.channel_list(spec)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(names, "|").alias("channels"))


AFTER_MID = f"FROM events WHERE epoch_us(ts) > {int(MID_MONTH)}::BIGINT * 1000000"


@query(
    "incremental_read",
    f"SELECT event_id, ts, (SELECT epoch_us(max(ts)) / 1e6::DOUBLE FROM events) AS since_utc {AFTER_MID}",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = P.newer_than(events, MID_MONTH, "ts")
    mark = P.newest_mark(kept, MID_MONTH, "ts").scalar()
    return kept.select("event_id", "ts").withColumn("since_utc", mark)


@query(
    "watermark_store",
    f"""WITH m AS (SELECT epoch_us(max(ts)) AS us FROM events WHERE epoch_us(ts) <= {int(MID_MONTH)}::BIGINT * 1000000)
    SELECT event_id, ts, us / 1e6::DOUBLE AS since_utc FROM events, m WHERE epoch_us(ts) > us""",
)
def _(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "mark")
    first_delivery = events.filter(epoch_seconds(F.col("ts")) <= MID_MONTH)
    W.save_mark(P.newest_mark(first_delivery, W.read_mark(spark, path), "ts"), path)
    mark = W.read_mark(spark, path)
    return P.newer_than(events, mark, "ts").select("event_id", "ts", F.lit(mark).alias("since_utc"))


@query(
    "fetch_run",
    f"""WITH {SUBMISSIONS},
      newest AS (SELECT * FROM posts WHERE epoch_us(posted_at) > {START + 1000}::BIGINT * 1000000
        QUALIFY row_number() OVER (PARTITION BY channel ORDER BY posted_at DESC, 'reddit_' || id) <= 25),
      src AS (SELECT doc_id AS id, 'reddit_' || id AS external_id, title || ' - ' || trim(body, E' \\t\\n\\r') AS raw_text, posted_at AS created_at
        FROM newest WHERE doc_id % 13 <> 0),
      c AS (SELECT *, {Q.clean('raw_text')} AS clean_text FROM src), s AS (SELECT *, {SEEN} FROM c),
      l AS (SELECT * EXCLUDE (seen), {keyword_case(0)} AS category, {keyword_case(1)} AS sentiment, {keyword_case(2)} AS urgency_score FROM s),
      {Q.scored('l')}
    SELECT external_id, raw_text, clean_text, created_at, category, sentiment, urgency_score, priority_score FROM scored""",
)
def _(spark, sf_dir):
    """Posts from a landed feed to the scored table; the second run finds the mark and nothing new."""
    posts, mark = landed_submissions(spark, sf_dir), scratch_path(spark, "mark")
    W.save_mark(spark.range(1).select(F.lit(START + 1000.0).alias("since_utc")), mark)

    def nothing(since):
        return P.normalize_submissions(posts.limit(0), since)

    def landed(since):
        return P.normalize_submissions(posts, since)

    name = _new_table(spark)
    channels = [r["channel"] for r in posts.select("channel").distinct().collect()]
    for _ in range(2):
        fetch_run(spark, [nothing, landed], keyword_answers, name, mark, channels, 500)
    return _read_and_forget(
        spark, name, "external_id, raw_text, clean_text, created_at, category, sentiment, urgency_score, priority_score"
    )
