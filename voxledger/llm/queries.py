"""The operators as named queries over the whole given tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxledger.catalog.registry import Registry
from voxledger.llm import (
    audit,
    bpe,
    chat,
    embedding,
    fim,
    marked_words,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    toxicity,
    url_rules,
)
from voxledger.session import materialize

registry = Registry()

SHARDS = 40
# The four rules every URL is judged by.
URL_RULES = (
    url_rules.host_rule("net", "/", "block"),
    url_rules.host_rule("example.net", "/en/", "allow"),
    url_rules.host_rule("example.com", "/de/", "block"),
    url_rules.host_rule("org", "/fr/", "allow"),
)
# Literal parts of hosts and paths that mark spam where no rule fits.
SPAM_PARTS = (
    ".spam-farm.", ".free-bets.", ".casino.", "-casino.", ".casino-", "/casino/", ".poker.", "-poker.", ".viagra.", "-viagra-",
    ".porn.", ".xxx.", ".adult.", "/adult/", "cheap-pills.", ".click-bait.", "-lottery.", ".lottery.",
)
SPAM_RULES = tuple(url_rules.Rule(f"spam {part}", part, "block") for part in SPAM_PARTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _levels(level: str, parent: str | None, leaves: str) -> str:
    """SQL of the children below each parent of one level with their weights."""
    up = parent or "0"
    return f"SELECT {up} AS parent, {level} AS child, count(*)::DOUBLE AS weight FROM {leaves} GROUP BY ALL"


def _place_sql(leaves: str, suffix: str) -> str:
    """CTEs that descend the tree whose leaves are listed in ``leaves``."""
    out, above = [], "docs"
    for level, parent in (("region", None), ("rack", "region"), ("shard", "rack")):
        name = f"{level}{suffix}"
        at = f"{parent}{suffix}" if parent else "0"
        out.append(f"""
{name}_nodes AS ({_levels(level, parent, leaves)}),
{name}_of AS (
  SELECT n, any_value(doc_id) AS doc_id, arg_min(child, -ln(
      (('0x' || substr(md5(key || '#' || '{level} ' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight) AS {name}
  FROM (SELECT n, doc_id, key, {at} AS node FROM {above}) d JOIN {name}_nodes ON parent = node GROUP BY n),
{name}_docs AS (SELECT d.*, {name} FROM {above} d JOIN {name}_of USING (n))""")
        above = f"{name}_docs"
    return ",".join(out)


def _shard_twin() -> str:
    """SQL of the sharding query; the checksum of a text is counted byte by byte."""
    return f"""
WITH RECURSIVE crc_steps(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
leaves AS (SELECT s * 4 // {SHARDS} AS region, s * 8 // {SHARDS} AS rack, s AS shard FROM range({SHARDS}) t(s)),
grown AS (SELECT * FROM leaves UNION ALL SELECT 4, 8, {SHARDS}),
raw AS (SELECT row_number() OVER () AS n, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM raw, crc),
docs AS MATERIALIZED (
  SELECT n, doc_id, coalesce(doc_id::VARCHAR, '') AS key, length(h) // 2 + 16 AS size, text_crc32 FROM raw JOIN sums USING (n)),
{_place_sql("leaves", "").strip()},
{_place_sql("grown", "_next").strip()}
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, d.shard::INT AS shard,
  row_number() OVER (PARTITION BY d.shard ORDER BY substr(md5(d.key || '#slot'), 1, 13), d.doc_id NULLS FIRST, d.size, d.text_crc32) - 1 AS slot,
  g.shard_next::INT AS grown_shard
FROM shard_docs d JOIN shard_next_docs g USING (n)"""


@registry.query("op1_sharding", _shard_twin())
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard in a tree of 40 and in the tree grown by one."""
    out = sharding.shard_rows(table(spark, sf_dir, "documents"), "doc_id", "text", sharding.even_tree(SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@registry.query("op2_quality_rules")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the weakly supervised verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    stats = materialize(docs.select("doc_id", quality.text_stats("text").alias("stats")), "quality")
    s, model = F.col("stats"), quality.fit_quality(stats, "stats")
    return stats.select(
        "doc_id",
        *(s[name].alias(name) for name in quality.BASE),
        quality.base_failed(s).alias("base_failed"),
        quality.judge(s, model).alias("kept"),
        quality.quality_probability(s, model).alias("probability"),
    )


@registry.query("op3_pii")
def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts of strict spans, and digests of spans."""
    found = pii.find_pii(table(spark, sf_dir, "documents"), "doc_id", "text")
    strict = F.filter("spans", lambda s: s["base"])

    def count(number: int):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == number))).cast("bigint")

    return found.select(
        "doc_id",
        *(count(number).alias(f"n_{kind}") for number, kind in enumerate(pii.KINDS)),
        F.sha2(pii.listed(strict), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@registry.query("op4_toxicity")
def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels, "doc_id", "text", "toxic")


URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut),
judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN {" OR ".join(f"contains('.' || host || path, '{part}')" for part in SPAM_PARTS)} THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


@registry.query("op5_url_filter", URL_SQL)
def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's address."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path, won = url_rules.judge_urls(pages, "url", (*URL_RULES, *SPAM_RULES))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), won.alias("won"))
    named = F.when(F.col("won.rule").isin(*(r.name for r in URL_RULES)), F.col("won.rule"))
    return judged.select("page_id", "host", "path", named.alias("rule"), F.col("won.verdict").alias("verdict"))


@registry.query("op6_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# A conversation that quotes the template's control strings.
QUOTED = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{QUOTED}' UNION ALL SELECT -1, 1, 'assistant', '{QUOTED}'),
heard AS (
  SELECT *, replace(replace(text, '\\', '\\s'), '<|', '\\l|') AS content,
    replace(replace(replace(role, '\\', '\\s'), '<|', '\\l|'), chr(10), '\\n') AS head FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, content)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, content) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(head) + 1 + length(content) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM heard GROUP BY conv_id"""


@registry.query("op7_chat_format", CHAT_SQL)
def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    quoted = spark.range(2).select(
        F.lit(-1).cast("bigint"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(QUOTED)
    )
    turns = rows.union(quoted).withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_conversations(turns, "conv_id", "turn", "role", "parts")
    read = done.select(
        "conv_id",
        "n_turns",
        F.array_join(
            F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
        ).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@registry.query("op8_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", str(path), pattern)
    both = ids.withColumn("decoded", bpe.decode_column(F.col("ids"), str(path), pattern))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@registry.query("op9_embedding_dedup")
def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of every vector at a cosine of 0.9."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


@registry.query("op10_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 1,024 tokens."""
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@registry.query("op11_sentencepiece")
def sentencepiece_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's piece ids and of the text they decode to."""
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    ids = marked_words.encode_documents(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    both = ids.withColumn("decoded", marked_words.decode_column(F.col("ids"), path))
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


AUDIT_SQL = """
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
failed AS (
  SELECT part, doc_id, [
    len(words) < 50,
    100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(first_id < doc_id, false)] AS fails
  FROM worded),
rows_of AS (
  SELECT part, fails, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM failed),
classes AS (SELECT part, fails, count(*) AS held, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM rows_of GROUP BY ALL),
orders AS (
  SELECT [a, b, c, d, e] AS o FROM range(1, 6) t(a), range(1, 6) u(b), range(1, 6) v(c), range(1, 6) w(d), range(1, 6) x(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5),
steps AS (SELECT o, step::INT AS step, o[step] AS f, o[1 : step - 1] AS before FROM orders, range(1, 6) t(step)),
counted AS (
  SELECT part, o, step, f, bool_alive, fails[f] AS hit, len(list_filter(fails, lambda x: x)) = 1 AS alone, held, good, toxic
  FROM (SELECT *, len(list_filter(before, lambda k: fails[k])) = 0 AS bool_alive FROM classes, steps)),
summed AS (
  SELECT part, o, step, f, coalesce(sum(held) FILTER (bool_alive AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(held) FILTER (bool_alive AND hit), 0)::BIGINT AS removed,
    coalesce(sum(held) FILTER (NOT bool_alive AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(held) FILTER (hit AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (bool_alive AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (bool_alive AND hit), 0)::BIGINT AS toxic_lost
  FROM counted GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, kept, removed, redundant,
  unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM summed"""


@registry.query("op12_filter_audit", AUDIT_SQL)
def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, within each source."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit.audit_documents(docs, labels, "doc_id", "source", "text", "quality", "toxic")


FIM_SQL = """
WITH texts AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM texts),
cut AS (
  SELECT *, array_to_string(units[1 : least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1 : greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1 :], '') AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM cut"""


@registry.query("op13_fill_in_middle", FIM_SQL)
def fim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of every document's transformed and restored text."""
    pieces = fim.output_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", fim.Rates(42, 50, 80))
    return fim.digest_restored(fim.digest_output(pieces)).withColumnRenamed("doc", "doc_id")
