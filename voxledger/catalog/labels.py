"""Batching, prompts and the handling of model answers.

Answers are derived from the tables, in every shape a model gives them: fenced,
with stray text, too short, too long, cut off, with labels outside the domain
and urgencies of every JSON type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from voxledger.catalog import sql as Q
from voxledger.catalog.keyword_answers import KEYWORDS, keyword_answers
from voxledger.catalog.registry import query
from voxledger.functions import labels as L
from voxledger.functions.text import clean_text
from voxledger.operators import enrichment as E
from voxledger.plans.ingest import ingest_run
from voxledger.session import scratch_path
from voxledger.sources.driver_tables import table
from voxledger.sources.feedback_table import create_feedback_table

# One label object per row, as SQL text both engines evaluate on (id, lang).
OBJECT = """'{"category": ' || CASE id % 9 WHEN 0 THEN '"Bug"' WHEN 1 THEN '"Feature Request"' WHEN 2 THEN '"Complaint"'
    WHEN 3 THEN '"Spam"' WHEN 4 THEN '"Praise"' WHEN 5 THEN '"bug"' WHEN 6 THEN '5' WHEN 7 THEN 'null' ELSE '"Other"' END
  || CASE lang WHEN 'en' THEN ', "sentiment": "Negative"' WHEN 'fr' THEN ', "sentiment": "Positive"'
    WHEN 'de' THEN '' ELSE ', "sentiment": "mixed"' END
  || CASE id % 10 WHEN 0 THEN ', "urgency_score": 4' WHEN 1 THEN ', "urgency_score": 4.7' WHEN 2 THEN ', "urgency_score": " 3 "'
    WHEN 3 THEN ', "urgency_score": "4.7"' WHEN 4 THEN ', "urgency_score": true' WHEN 5 THEN ', "urgency_score": null'
    WHEN 6 THEN '' WHEN 7 THEN ', "urgency_score": 99999999999' WHEN 8 THEN ', "urgency_score": -2'
    ELSE ', "urgency_score": [5]' END || '}'"""

CATEGORY = """CASE id % 9 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Feature Request' WHEN 2 THEN 'Complaint'
  WHEN 3 THEN 'Spam' WHEN 4 THEN 'Praise' ELSE 'Uncategorized' END"""
SENTIMENT = "CASE lang WHEN 'en' THEN 'Negative' WHEN 'fr' THEN 'Positive' ELSE 'Neutral' END"
URGENCY = "CASE id % 10 WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 7 THEN 5 ELSE 1 END"

# Row answers: the object in one of seven wrappings; 4 to 6 are unusable.
ROW_ANSWER = """CASE (id // 10) % 7 WHEN 0 THEN obj WHEN 1 THEN '```json' || chr(10) || obj || chr(10) || '```'
  WHEN 2 THEN 'Sure: ' || obj || ' Done.' WHEN 3 THEN '  ```' || obj || '```  ' WHEN 4 THEN replace(obj, '}', '')
  WHEN 5 THEN 'no idea' ELSE replace(obj, '"category": ', '"category": [1], "was": ') END"""
ROW_OK = "(id // 10) % 7 < 4"


def _spark_sql(text: str) -> str:
    return text.replace("id // 10", "id div 10")


def _documents(spark, sf_dir):
    """All documents under even ids, and blank rows between them."""
    rows, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    whole = rows.select((doc * 2).alias("id"), "lang", clean_text(F.col("text")).alias("clean_text"))
    blank = rows.filter(doc % 9 == 4).select((doc * 2 + 1).alias("id"), "lang", F.lit("  ").alias("clean_text"))
    return whole.unionByName(blank)


DOCS = f"""docs AS (SELECT doc_id * 2 AS id, lang, {Q.clean('text')} AS clean_text FROM documents
  UNION ALL SELECT doc_id * 2 + 1, lang, '  ' FROM documents WHERE doc_id % 9 = 4)"""
BATCHED = f"""{DOCS}, batched AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 15 AS batch_id,
    CAST((row_number() OVER (ORDER BY id) - 1) % 15 AS INT) AS pos FROM docs),
  numbered AS (SELECT *, CASE WHEN trim(clean_text) <> '' THEN
      CAST(count(*) FILTER (trim(clean_text) <> '') OVER (PARTITION BY batch_id ORDER BY pos) AS INT) END AS item,
    count(*) FILTER (trim(clean_text) <> '') OVER (PARTITION BY batch_id) AS items FROM batched)"""


def _row_answers(spark, sf_dir):
    rows = _documents(spark, sf_dir)
    return rows.withColumn("obj", F.expr(OBJECT)).withColumn("response", F.expr(_spark_sql(ROW_ANSWER))).drop("obj")


def _numbered(spark, sf_dir):
    return E.with_item_number(E.micro_batches(_documents(spark, sf_dir)))


def _batch_answers(numbered):
    """One answer per batch, in eight shapes; 5 to 7 fail as a whole."""
    objects = numbered.filter("item IS NOT NULL").groupBy("chunk", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("item", F.expr(OBJECT).alias("obj")))).alias("o")
    )
    shape = F.col("batch_id") % 8
    listed = F.col("o.obj")
    kept = F.when(shape == 3, F.slice(listed, F.lit(1), F.greatest(F.size("o") - 2, F.lit(0)))).otherwise(listed)
    extra = F.when(shape == 4, ', {"category": "Spam"}').when(shape == 6, ", 7").otherwise("")
    body = F.concat(F.lit("["), F.array_join(kept, ", "), extra, F.lit("]"))
    answer = (
        F.when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Here you are:\n"), body, F.lit("\nAll done.")))
        .when(shape == 5, F.substring(body, 1, 40))
        .when(shape == 7, F.element_at(listed, 1))
        .otherwise(body)
    )
    return objects.select("chunk", "batch_id", answer.alias("response"))


# The fields of an object before they are validated, as text.
RAW_CATEGORY = """CASE id % 9 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Feature Request' WHEN 2 THEN 'Complaint' WHEN 3 THEN 'Spam'
  WHEN 4 THEN 'Praise' WHEN 5 THEN 'bug' WHEN 6 THEN '5' WHEN 8 THEN 'Other' END"""
RAW_SENTIMENT = "CASE lang WHEN 'en' THEN 'Negative' WHEN 'fr' THEN 'Positive' WHEN 'es' THEN 'mixed' END"
RAW_URGENCY = """CASE id % 10 WHEN 0 THEN '4' WHEN 1 THEN '4.7' WHEN 2 THEN ' 3 ' WHEN 3 THEN '4.7' WHEN 4 THEN 'true'
  WHEN 7 THEN '99999999999' WHEN 8 THEN '-2' WHEN 9 THEN '[5]' END"""


def _raw_fields(parsed):
    """Category, sentiment and urgency of a parsed object as text."""
    return [
        F.try_variant_get(parsed, f"$.{name}", "string").alias(name) for name in ("category", "sentiment", "urgency_score")
    ]


@query(
    "parse_label_object",
    f"""WITH {DOCS}, w AS (SELECT *, {ROW_OK} AS ok, (id // 10) % 7 = 6 AS odd FROM docs)
    SELECT id, ok OR odd AS parsed, CASE WHEN ok THEN {RAW_CATEGORY} WHEN odd THEN '[1]' END AS category,
      CASE WHEN ok OR odd THEN {RAW_SENTIMENT} END AS sentiment, CASE WHEN ok OR odd THEN {RAW_URGENCY} END AS urgency_score FROM w""",
)
def _(spark, sf_dir):
    rows = _row_answers(spark, sf_dir).select("id", L.parse_object(F.col("response")).alias("v"))
    return rows.select("id", F.col("v").isNotNull().alias("parsed"), *_raw_fields(F.col("v")))


@query(
    "validate_labels",
    f"WITH {DOCS} SELECT id, {CATEGORY} AS category, {SENTIMENT} AS sentiment, {URGENCY} AS urgency_score FROM docs",
)
def _(spark, sf_dir):
    labels = L.validate(F.try_parse_json(F.expr(OBJECT)))
    return _documents(spark, sf_dir).select("id", labels.alias("l")).select("id", "l.*")


@query(
    "classify_rows",
    f"""WITH {DOCS}, ok AS (SELECT *, {ROW_OK} AND trim(clean_text) <> '' AS ok FROM docs)
    SELECT id, CASE WHEN ok THEN {CATEGORY} ELSE 'Uncategorized' END AS category,
      CASE WHEN ok THEN {SENTIMENT} ELSE 'Neutral' END AS sentiment, CASE WHEN ok THEN {URGENCY} ELSE 1 END AS urgency_score FROM ok""",
)
def _(spark, sf_dir):
    answers = _row_answers(spark, sf_dir).select("id", "response")
    labelled = E.classify_rows(_documents(spark, sf_dir), answers)
    return labelled.select("id", "category", "sentiment", "urgency_score")


@query("micro_batches", f"WITH {BATCHED} SELECT id, batch_id, pos FROM batched")
def _(spark, sf_dir):
    return E.micro_batches(_documents(spark, sf_dir)).select("id", "batch_id", "pos")


@query(
    "build_batch_prompts",
    f"""WITH {BATCHED} SELECT batch_id, CAST(count(*) AS INT) AS item_count,
      string_agg(item || '. "' || substring(clean_text, 1, 1000) || '"', chr(10) ORDER BY item) AS items
    FROM numbered WHERE item IS NOT NULL GROUP BY batch_id""",
)
def _(spark, sf_dir):
    return E.build_batch_prompts(E.micro_batches(_documents(spark, sf_dir))).drop("prompt", "chunk")


@query(
    "parse_label_array",
    f"""WITH {BATCHED}, o AS (
      SELECT batch_id, item, items, {RAW_CATEGORY} AS category, {RAW_SENTIMENT} AS sentiment FROM numbered
      WHERE item IS NOT NULL AND batch_id % 8 NOT IN (5, 7) AND NOT (batch_id % 8 = 3 AND item > items - 2)
      UNION ALL SELECT DISTINCT batch_id, items + 1, items, CASE batch_id % 8 WHEN 4 THEN 'Spam' END, NULL FROM numbered
      WHERE items > 0 AND batch_id % 8 IN (4, 6))
    SELECT batch_id, CAST(item AS INT) AS item, category, sentiment FROM o""",
)
def _(spark, sf_dir):
    parsed = L.parse_array(F.col("response"))
    each = _batch_answers(_numbered(spark, sf_dir)).select("batch_id", F.posexplode(parsed).alias("pos", "v"))
    return each.select("batch_id", (F.col("pos") + 1).alias("item"), *_raw_fields(F.col("v"))[:2])


@query(
    "apply_batch_responses",
    f"""WITH {BATCHED}, ok AS (SELECT *, item IS NOT NULL AND batch_id % 8 < 5 AND NOT (batch_id % 8 = 3 AND item > items - 2) AS ok FROM numbered)
    SELECT id, batch_id, pos, CASE WHEN ok THEN {CATEGORY} ELSE 'Uncategorized' END AS category,
      CASE WHEN ok THEN {SENTIMENT} ELSE 'Neutral' END AS sentiment, CASE WHEN ok THEN {URGENCY} ELSE 1 END AS urgency_score FROM ok""",
)
def _(spark, sf_dir):
    numbered = E.keep_batches(_numbered(spark, sf_dir))
    labelled = E.apply_batch_responses(numbered, _batch_answers(numbered))
    return labelled.select("id", "batch_id", "pos", "category", "sentiment", "urgency_score")


def keyword_case(field: int) -> str:
    """The rules of the keyword scorer as SQL over ``seen``, the text a prompt holds."""
    arms = " ".join(
        "WHEN regexp_matches(seen, '{}') THEN {}".format("|".join(words), repr(labels[field])) for words, labels in KEYWORDS
    )
    return f"CASE {arms} ELSE {repr(('Spam', 'Neutral', 1)[field])} END"


SEEN = "lower(substring(clean_text, 1, 1000)) AS seen"


@query(
    "ingest_run",
    f"""WITH src AS (SELECT doc_id AS id, 'tweet' AS source, text AS raw_text, {Q.clean('text')} AS clean_text,
        TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id AS created_at FROM documents),
      s AS (SELECT *, {SEEN} FROM src),
      l AS (SELECT * EXCLUDE (seen), {keyword_case(0)} AS category, {keyword_case(1)} AS sentiment, {keyword_case(2)} AS urgency_score FROM s),
      {Q.scored('l')}
    SELECT id, source, raw_text, clean_text, created_at, category, sentiment, urgency_score, priority_score FROM scored""",
)
def _(spark, sf_dir):
    minutes = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.lit("tweet").alias("source"),
        F.col("text").alias("raw_text"),
        F.date_format(minutes, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_at"),
    )
    path = scratch_path(spark, "feedback")
    name = "feedback_" + path[-12:]
    create_feedback_table(spark, name, path)
    ingest_run(raw, keyword_answers, name)
    loaded = spark.table(name).drop("external_id")
    spark.sql(f"DROP TABLE {name}")
    return loaded
