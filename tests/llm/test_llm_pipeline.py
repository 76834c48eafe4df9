"""The pipeline's stages against plain versions, and whole."""

import itertools
import re

import corpus_pipeline
import pyarrow as pa
import pytest
from plain import SPACE, base_spans, components, quality
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Inputs and results of all stages, each written and read again."""
    from voxledger.session import materialize

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        done = materialize(stage(spark, docs, sf_dir), name)
        out[name] = (docs, done)
        docs = done
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_documents(stages, spark, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(done.columns == columns for name, (_, done) in stages.items() if name != "packing")


def test_toxicity(stages, spark, sf_dir):
    from voxledger.llm import toxicity

    before, after = map(rows, stages["toxicity"])
    found = toxicity.automaton(toxicity.LEXICON, toxicity.EXCEPTIONS)
    # The smallest tables have too few toxic documents in other languages to learn from.
    for doc_id, row in before.items():
        assert (doc_id in after) == (not toxicity.find_terms(row["text"] or "", found))
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(doc_id in after for doc_id, toxic in labels.items() if not toxic)
    assert all(after[i] == before[i] for i in after)


def test_quality(stages, spark, sf_dir):
    before, after = map(rows, stages["quality_rules"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    for doc_id, row in before.items():
        counts = quality(row["text"])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert not (failed and doc_id in after)
        if labels.get(doc_id) and not failed:
            assert after[doc_id] == row


def test_simhash(stages):
    """Texts whose five-word shingles are alike by four fifths are one group, all pairs compared."""
    before, after = map(rows, stages["simhash"])

    def shingles(text):
        words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}

    sets = {i: shingles(r["text"]) for i, r in before.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert links
    assert set(after) == set(components(sets, links).values())
    assert all(after[i] == before[i] for i in after)


def test_pii(stages):
    before, after = map(rows, stages["pii"])
    assert set(before) == set(after)
    for i, row in before.items():
        if base_spans(row["text"]):
            assert not base_spans(after[i]["text"])
        assert after[i]["n_chars"] == len(after[i]["text"])


def test_packing(stages):
    docs, pieces = stages["packing"]
    held = {}
    for r in pieces.collect():
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(held) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    for parts in held.values():
        at = 0
        for start, length, total in sorted(parts):
            assert start == at
            at += length
        assert at == total


def test_run_and_empty_input(spark, sf_dir, stages, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packing"][1].count()
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, odd_docs, tmp_path):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES if name != "pii"])
def test_stages_bound_what_goes_to_a_worker_at_once(spark, sf_dir, stage):
    """Long rows go to Python workers in batches of a few MB, and not in one of 10,000 rows or 64 MB."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    long = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = [r["n"] for r in long.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) >= 200 * 100_000
    assert max(found) <= 5_000_000
