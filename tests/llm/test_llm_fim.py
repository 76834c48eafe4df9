"""Fill-in-middle texts against a plain version; the query itself has SQL."""

import hashlib
import re

import pytest
from plain import prose, sha

from voxledger.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text, rates=fim.Rates()):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{rates.seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rates.transformed:
        return len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{suffix}<P>{prefix}<M>{middle}") if h4 % 100 < rates.suffix_first else ("psm", f"<P>{prefix}<S>{suffix}<M>{middle}")
    return len(units), form, len(prefix), len(middle), out


def digests(docs, rates=fim.Rates()):
    return fim.digest_restored(fim.digest_output(fim.output_pieces(docs, "doc_id", "text", rates)))


def compare(docs, rates=fim.Rates()):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [(i, t, plain(i, t, rates)) for i, t in rows]
    got = sorted(str(tuple(r)) for r in digests(docs, rates).collect())
    assert got == sorted(str((i, *p[:4], sha(p[4]), sha(t or ""))) for i, t, p in want)
    texts = fim.output_texts(fim.output_pieces(docs, "doc_id", "text", rates)).collect()
    assert sorted(str(tuple(r)) for r in texts) == sorted(str((i, p[1], p[4])) for i, _, p in want)


@pytest.fixture()
def small_pieces(monkeypatch):
    monkeypatch.setattr(fim, "UNITS", 3)


def test_odd_documents(odd_docs, no_docs):
    compare(odd_docs)
    assert digests(no_docs).count() == 0


def test_pieces_of_three_units(spark, small_pieces):
    rows = [(i, prose(i % 40, i)) for i in range(200)] + [(7, "a <P> b"), (8, "<M>"), (9, "<S"), (10, " \n "), (11, "<" + "P> x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    compare(docs, fim.Rates(1, 100, 50))
    compare(docs, fim.Rates(2, 100, 100))


def test_a_third_of_all_rows_are_one_row(spark, small_pieces):
    rows = [(5, prose(30))] * 100 + [(5, prose(20, i)) for i in range(60)] + [(i, prose(10, i)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    compare(docs, fim.Rates(3, 100, 50))


def test_text_ids(spark):
    compare(spark.createDataFrame([("x", prose(9)), (None, prose(8)), ("", "")], "doc_id string, text string"), fim.Rates(4, 100, 50))


def test_one_shuffle(spark, odd_docs):
    plan = digests(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
