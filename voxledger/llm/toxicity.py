"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: lower case, homoglyphs and accents to plain letters,
digits and signs next to letters to the letters they stand for. One pass of the
automaton finds lexicon words at word boundaries; hits inside an exception phrase
do not count. A word's weight is its log odds between toxic and clean labelled
documents, and the hits' weight, alone and per length, gives the score through a
logistic curve fitted on the labelled documents.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.llm.weak_labels import fit_logistic
from voxledger.session import materialize, ship_by_value

ship_by_value(__name__)

# Insults and slurs of general word lists, without weights.
LEXICON = tuple(
    "arschloch asshole bastard bitch bastardo cabron clown connard crap creep cretin cretino degenerate dickhead disgusting "
    "dumb dummkopf dumbass estupido fool freak garbage gilipollas hate hideous horrible idiot idiota idiote imbecil imbecile "
    "jackass jerk kill loser lunatic maggot miststueck moron nazi nasty pathetic pendejo pig psycho putain puta retard retarded "
    "salaud salope scum shit shithead slut stupid stupide subnormal trash ugly useless vermin whore wichser worthless".split()
)
# Harmless phrases that hold a lexicon word.
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "clown fish", "class clown", "guinea pig", "garbage collection", "garbage collector",
    "garbage can", "fool proof", "jerk chicken", "hate to say", "kill switch", "kill time", "stupid simple", "pig iron",
)
# Cyrillic and Greek letters that look like Latin ones.
HOMOGLYPHS = dict(zip("авеікмнорстухѕјԁɡαεικνορτυχ", "abeikmhopctyxsjdgaeikvoptux", strict=True))
# Digits and signs written for letters.
DIGITS = str.maketrans("0134578@$!", "oieastbasi")
_BESIDE = re.compile(r"(?<=[a-z])[0134578@$!]+(?=[a-z])|(?<![a-z0-9@$!])[0134578@$!]+(?=[a-z])")
# Words and stems are learned from at most so many toxic documents without a lexicon word and so many clean ones.
LEARN_TOXIC, LEARN_CLEAN = 1_500, 3_000
# What is learned stands in at least so many of the toxic ones, its log odds exceed the second, and its log likelihood ratio
# against being as frequent in clean ones the third: chance gives that to one term in 160,000, however rare the term is.
LEARN_ROWS, LEARN_ODDS, LEARN_EVIDENCE = 4, 3.0, 12.0
# Letters of a stem.
STEMS = (4, 5, 6)
# Minima of word triples that all agree in copies of a text.
SKETCH_SEEDS = 6
HITS_TYPE = "struct<hits: array<struct<term: int, n: int>>, length: bigint, print: bigint>"
# Signs without a width of their own: accents behind their letter, joiners, soft hyphens.
UNSEEN = (0xAD, *range(0x300, 0x370), *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF)


class ToxicityModel(NamedTuple):
    terms: tuple[str, ...]
    weights: tuple[float, ...]
    curve: tuple[float, float, float]


@lru_cache
def _plain() -> dict[int, str]:
    """Accented Latin letters and full-width forms to plain letters, by Unicode's own decompositions; unseen signs to nothing."""
    out = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        base = unicodedata.normalize("NFKD", chr(code))[:1]
        if base.isascii() and base != chr(code):
            out[code] = base.lower()
    return out | {ord(k): v for k, v in HOMOGLYPHS.items()} | dict.fromkeys(UNSEEN)


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_plain())
    return _BESIDE.sub(lambda m: m[0].translate(DIGITS), text).replace("l", "i")


@lru_cache(maxsize=8)
def automaton(terms: tuple[str, ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """Terms, those that end in ``*`` as stems, and exception phrases under number -1."""
    out = ahocorasick.Automaton()
    keys: dict[str, tuple[int, int, bool]] = {}
    for number, term in enumerate(terms):
        key = fold(term.removesuffix("*"))
        keys.setdefault(key, (number, len(key), term.endswith("*")))
    for key in map(fold, exceptions):
        keys[key] = (-1, len(key), False)
    for key, value in keys.items():
        out.add_word(key, value)
    out.make_automaton()
    return out


def find_terms(text: str, found: ahocorasick.Automaton) -> dict[int, int]:
    """How often each term stands in a text as a word or, for stems, begins one, outside exception phrases."""
    return find_folded(fold(text), found)


def find_folded(folded: str, found: ahocorasick.Automaton) -> dict[int, int]:
    """As :func:`find_terms`, in a text that is folded already."""
    hits, spared = [], []
    for end, (number, length, stem) in found.iter(folded):
        start = end + 1 - length
        if start and folded[start - 1].isalnum():
            continue
        if not stem and end + 1 < len(folded) and folded[end + 1].isalnum():
            continue
        (spared if number < 0 else hits).append((start, end, number))
    out: dict[int, int] = {}
    spared.sort()
    # How far the phrases reach that begin no later than the hit.
    at, reach = 0, -1
    for start, end, number in sorted(hits):
        while at < len(spared) and spared[at][0] <= start:
            reach = max(reach, spared[at][1])
            at += 1
        if end > reach:
            out[number] = out.get(number, 0) + 1
    return out


def text_print(folded: str) -> int:
    """A hash of a folded text, by which copies are told."""
    return int.from_bytes(hashlib.blake2b(folded.encode(), digest_size=8).digest(), "little", signed=True)


def term_hits(text: Column, terms: Sequence[str], exceptions: Sequence[str] = EXCEPTIONS) -> Column:
    """Counts of the terms found in a whole text, its length and a hash of it folded; a null text is an empty one."""
    terms, exceptions = tuple(terms), tuple(exceptions)

    @arrow_udf(HITS_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        found = automaton(terms, exceptions) if terms else None
        folds = ((fold(t or ""), len(t or "")) for t in texts.to_pylist())
        rows = [(find_folded(folded, found) if found else {}, length, text_print(folded)) for folded, length in folds]
        return pa.array(
            [{"hits": [{"term": k, "n": n} for k, n in sorted(hits.items())], "length": length, "print": own} for hits, length, own in rows],
            pa.struct([("hits", pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))), ("length", pa.int64()), ("print", pa.int64())]),
        )

    return scan(text)


def loads(found: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """Weight of the hits, each term damped by the logarithm of its count: in all, and per thousand characters."""
    table = F.array(*map(F.lit, weights)) if weights else F.array(F.lit(0.0))
    total = F.aggregate(
        found["hits"],
        F.lit(0.0),
        lambda sum_, hit: sum_ + F.coalesce(F.element_at(table, hit["term"] + 1), F.lit(0.0)) * F.log1p(hit["n"].cast("double")),
    )
    return F.log1p(total), F.log1p(total * 1000 / (found["length"] + 200))


def score(found: Column, model: ToxicityModel) -> Column:
    total, dense = loads(found, model.weights)
    a, b, c = model.curve
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * total + F.lit(b) * dense + F.lit(c))))


def weigh(scanned: DataFrame, found: str, label: str, terms: Sequence[str]) -> tuple[float, ...]:
    """Log odds of each term between toxic and clean documents; one row per term reaches the driver."""
    toxic = F.sum(F.col(label).cast("bigint"))
    n, bad = scanned.agg(F.count(F.lit(1)), F.coalesce(toxic, F.lit(0))).first()
    by_term = {
        r["term"]: (r["n"], r["bad"])
        for r in scanned.select(F.explode(F.col(f"{found}.hits.term")).alias("term"), label)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), toxic.alias("bad"))
        .collect()
    }
    out = []
    for number in range(len(terms)):
        seen, seen_bad = by_term.get(number, (0, 0))
        odds = np.log((seen_bad + 0.5) / (bad + 1)) - np.log((seen - seen_bad + 0.5) / (n - bad + 1))
        # A word that no label speaks of keeps half a unit of suspicion.
        out.append(float(np.clip(odds, 0, 8)) if seen else 0.5)
    return tuple(out)


def _terms_of(texts: DataFrame) -> DataFrame:
    """Each document's words and stems, one document of those that agree in all minima of their word triples: near copies do."""
    words = texts.select("label", *(F.split(F.lower("text"), rf"[^{kept}]+").alias(name) for name, kept in (("w", r"\p{L}"), ("all", r"\p{L}\p{N}"))))
    triples = F.arrays_zip(F.col("all").alias("a"), F.slice("all", 2, 1 << 30).alias("b"), F.slice("all", 3, 1 << 30).alias("c"))

    def least(seed: int) -> Column:
        return F.array_min(F.transform(triples, lambda t: F.xxhash64(F.lit(seed), t["a"], t["b"], t["c"])))

    def terms(word: Column) -> Column:
        return F.array(word, *(F.when(F.length(word) > n, F.concat(F.left(word, F.lit(n)), F.lit("*"))) for n in STEMS))

    long = F.filter(F.array_distinct("w"), lambda word: F.length(word) >= min(STEMS))
    listed = F.array_distinct(F.array_compact(F.flatten(F.transform(long, terms)))).alias("terms")
    sketch = F.array(*map(least, range(SKETCH_SEEDS))).alias("sketch")
    return words.select("label", sketch, listed).dropDuplicates(["label", "sketch"])


def evidence(toxic: Column, clean: Column, toxic_rows: int, clean_rows: int) -> Column:
    """Log likelihood ratio of a term's counts against one share in both kinds of documents."""
    share, both = toxic_rows / max(toxic_rows + clean_rows, 1), toxic + clean
    of_clean = F.when(clean > 0, clean * F.ln(clean / (both * F.lit(1 - share)))).otherwise(0.0)
    return toxic * F.ln(toxic / (both * F.lit(share))) + of_clean


def learn_terms(source: DataFrame, train: DataFrame) -> tuple[str, ...]:
    """Words and stems of toxic documents in which the lexicon finds nothing, and that clean ones lack.

    A documented bound of labelled texts is learned from, picked by a hash of the id
    after copies are told apart; near copies count once. Their ids are few enough to
    travel to the texts. What is learned depends on the evidence alone, not on a share
    of the documents or a number of terms, which the sample bounds.
    """

    def pick(part: DataFrame, rows: int) -> DataFrame:
        texts = part.groupBy("label", F.col("found.print").alias("print")).agg(F.min("id").alias("id"))
        return texts.select("id", "label").orderBy(F.xxhash64("id"), "id").limit(rows)

    silent = pick(train.filter((F.col("label") == 1) & (F.size("found.hits") == 0)), LEARN_TOXIC)
    picked = materialize(silent.union(pick(train.filter("label = 0"), LEARN_CLEAN)), "picked")
    docs = materialize(_terms_of(source.join(F.broadcast(picked), "id")), "picked-terms")
    sizes = {r["label"]: r["n"] for r in docs.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if bad < LEARN_ROWS:
        return ()
    toxic, clean = (F.count(F.when(F.col("label") == label, 1)) for label in (1, 0))
    rows = docs.select("label", F.explode("terms").alias("term")).groupBy("term").agg(toxic.alias("toxic"), clean.alias("clean"))
    odds = F.ln(F.col("toxic") / F.lit(bad)) - F.ln((F.col("clean") + 0.5) / F.lit(good + 1.0))
    firm = (F.col("toxic") >= LEARN_ROWS) & (evidence(F.col("toxic"), F.col("clean"), bad, good) >= LEARN_EVIDENCE)
    kept = rows.filter(firm & (odds > LEARN_ODDS)).orderBy(F.desc("toxic"), F.length("term"), "term")
    found = {r["term"]: (r["toxic"], r["clean"]) for r in kept.collect()}
    # A longer term that stands in the same documents as its stem says nothing more.
    return tuple(t for t in found if not any(found.get(t[:n] + "*") == found[t] for n in STEMS if n < len(t.removesuffix("*"))))


def fit_toxicity(scanned: DataFrame, found: str, label: str, terms: Sequence[str]) -> ToxicityModel:
    """Weights and curve from labelled documents that were scanned for ``terms``.

    The curve is fitted on counts per rounded pair of features, a table whose size
    depends on the rounding and not on the number of documents.
    """
    weights = weigh(scanned, found, label, terms)
    total, dense = loads(F.col(found), weights)
    table = (
        scanned.select(F.round(total, 1).alias("t"), F.round(dense, 1).alias("d"), label)
        .groupBy("t", "d")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("bad"))
        .collect()
    )
    if not table or not sum(r["bad"] for r in table):
        return ToxicityModel(tuple(terms), weights, (2.0, 0.5, -3.0))
    rows = np.array([(r["t"], r["d"], r["bad"] / r["n"], r["n"]) for r in sorted(table)], dtype=float)
    return ToxicityModel(tuple(terms), weights, tuple(map(float, fit_logistic(rows[:, :2], rows[:, 2], rows[:, 3], ridge=0.1))))


def train_part(id_: Column) -> Column:
    """Whether labels of this row may be learned from: its remainder is not 0."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def known_labels(labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """``id`` and ``label`` of the rows that may be learned from; of repeated ones the larger label."""
    part = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    return part.filter(F.col("label").isNotNull() & train_part(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))


def scan_and_fit(source: DataFrame, known: DataFrame, terms: Sequence[str]) -> tuple[DataFrame, ToxicityModel]:
    """Scanned documents (``id``, ``found``) and the model; scans again with learned words where the lexicon misses many."""

    def scan(words: Sequence[str]) -> DataFrame:
        return materialize(source.select("id", term_hits(F.col("text"), words).alias("found")), "toxic-hits")

    scanned = scan(terms)
    train = scanned.join(known, "id")
    more = tuple(w for w in learn_terms(source, train) if w not in terms)
    if more:
        terms = (*terms, *more)
        scanned = scan(terms)
        train = scanned.join(known, "id")
    return scanned, fit_toxicity(train, "found", "label", terms)


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str) -> ToxicityModel:
    """The model of a corpus and its labels, to score any text with."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scan_and_fit(source, known_labels(labels, id_col, label), LEXICON)[1]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: str) -> DataFrame:
    """Score of every document: the id, ``held_out``, ``score`` and ``predicted``.

    Only rows of :func:`train_part` are learned from. A null text is an empty one
    and gets the score of a text without hits; a null id is scored and never
    learned from; null labels are left out and repeated ones count once, the
    larger winning; without labels the lexicon's own weights decide. Other columns
    are ignored. Texts are read once (twice if words are learned), and only
    counts of hits are shuffled.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scanned, model = scan_and_fit(source, known_labels(labels, id_col, label), LEXICON)
    return scanned.select(
        F.col("id").alias(id_col),
        F.coalesce(~train_part(F.col("id")), F.lit(False)).alias("held_out"),
        score(F.col("found"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
