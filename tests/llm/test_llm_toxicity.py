"""Toxicity against plain versions, and learning from rare groups and from copies."""

import math
import random

import pytest
from plain import prose
from pyspark.sql import functions as F

from voxledger.llm import toxicity


def plain_hits(text, terms, exceptions):
    """All places of all terms, each compared with all places of all exception phrases."""
    folded, found = toxicity.fold(text), {}

    def places(key, stem):
        at = folded.find(key)
        while at >= 0:
            end = at + len(key)
            if not (at and folded[at - 1].isalnum()) and (stem or not folded[end : end + 1].isalnum()):
                yield at, end
            at = folded.find(key, at + 1)

    spared = [p for phrase in exceptions for p in places(toxicity.fold(phrase), False)]
    for number, term in enumerate(terms):
        for a, b in places(toxicity.fold(term.removesuffix("*")), term.endswith("*")):
            if not any(x <= a and b <= y for x, y in spared):
                found[number] = found.get(number, 0) + 1
    return found


def test_hits_against_all_places():
    rng = random.Random(3)
    terms = ("trash", "clown", "class*", "can", "fool", "idi*")
    exceptions = ("trash can", "class clown", "can fool", "trash can fool proof", "fool proof")
    found = toxicity.automaton(terms, exceptions)
    words = ["trash", "can", "fool", "proof", "class", "classy", "clown", "idiot", "tr4sh", "x", "ìdiot"]
    for _ in range(2000):
        text = " ".join(rng.choices(words, k=rng.randrange(9)))
        assert toxicity.find_terms(text, found) == plain_hits(text, terms, exceptions), text


def test_many_phrases_around_one_hit():
    phrases = tuple(f"{'a ' * k}fool" for k in range(1, 12))
    found = toxicity.automaton(("fool",), phrases)
    assert toxicity.find_terms("a " * 11 + "fool", found) == {}
    assert toxicity.find_terms("fool a fool", found) == {0: 1}


def test_disguise_by_signs_without_width():
    found = toxicity.automaton(("idiot",), ())
    for text in ("ïdiot", "ïdiot", "id​iot", "i­di⁠ot", "İdiot", "﻿idiot"):
        assert toxicity.find_terms(text, found) == {0: 1}, text


def labelled(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")


def test_score_against_the_formula(spark):
    rng = random.Random(1)
    insults = ["idiot", "scum", "loser"]
    rows = [(i, prose(rng.randrange(1, 80), i) + f" {rng.choice(insults)}" * (i % 3 == 0) * rng.randrange(1, 4), int(i % 3 == 0)) for i in range(300)]
    docs, labels = labelled(spark, rows + [(900, None, 0), (901, "", 0)])
    model = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels, "doc_id", "text", "toxic").collect()}
    a, b, c = model.curve
    for doc_id, text, _ in rows + [(900, "", 0), (901, "", 0)]:
        hits = plain_hits(text, model.terms, toxicity.EXCEPTIONS)
        total = sum(model.weights[k] * math.log1p(n) for k, n in hits.items())
        want = 1 / (1 + math.exp(-(a * math.log1p(total) + b * math.log1p(total * 1000 / (len(text) + 200)) + c)))
        assert got[doc_id]["score"] == pytest.approx(want, abs=1e-9)
        assert got[doc_id]["predicted"] == (got[doc_id]["score"] >= 0.5)


def test_rare_groups_are_learned(spark):
    """One toxic document in a hundred is of a language of its own."""
    rows = [(i, prose(30, i) + " zorblax", 1) for i in range(2000) if i % 100] + [(i, f"quend {i} vrille {i * 7}", 1) for i in range(0, 2000, 100)]
    rows += [(5000 + i, prose(40, i), 0) for i in range(4500)]
    docs, labels = labelled(spark, rows)
    terms = toxicity.learn(docs, labels, "doc_id", "text", "toxic").terms
    assert any("quend".startswith(t.removesuffix("*")) for t in terms) and any("zorblax".startswith(t.removesuffix("*")) for t in terms)


def test_copies_teach_once_and_shared_headers_do_not_make_copies(spark):
    header = prose(17, 5)
    different = spark.createDataFrame([(1, f"{header} {prose(40, i)} {i}") for i in range(1000)], "label int, text string")
    assert toxicity._terms_of(different).count() >= 990
    # Hundreds of copies of one labelled text are no evidence for its words.
    rows = [(i, "unique mumblety phrase", 1) for i in range(300)] + [(1000 + i, prose(40, i), 0) for i in range(300)]
    docs, labels = labelled(spark, rows + [(2000 + i, prose(50, i) + " zorblax", 1) for i in range(40)])
    terms = toxicity.learn(docs, labels, "doc_id", "text", "toxic").terms
    assert not any(t.startswith("mumb") for t in terms) and any("zorblax".startswith(t.removesuffix("*")) for t in terms)


def test_evidence_is_the_likelihood_ratio(spark):
    rows = spark.createDataFrame([(11, 0), (4, 0), (30, 3)], "t int, c int")
    got = [r[0] for r in rows.select(toxicity.evidence(F.col("t"), F.col("c"), 500, 1000)).collect()]
    assert got == pytest.approx([11 * math.log(3), 4 * math.log(3), 30 * math.log(30 / 11) + 3 * math.log(3 / 22)])
