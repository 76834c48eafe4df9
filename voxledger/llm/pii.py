"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Five labelers vote on each or abstain: the strict pattern,
a gazetteer, the words before it, what touches it, and its shape.
Expectation-maximisation over the vote patterns of all documents estimates how
reliable each is, and the posteriors train a logistic classifier on features of
the span, which has the last word on spans that no strict pattern decides. Spans
of the strict patterns always stay.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxledger.llm.weak_labels import ABSTAIN, AGAINST, FOR, fit_logistic, fit_votes
from voxledger.session import materialize

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("secret", "other")
# Leftmost, non-overlapping. Possessive quantifiers and the look-behinds only save
# retries inside a run that cannot succeed; \G lets a match begin where one ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
}
# What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]", "secret": r"[A-Za-z0-9_-]{16}"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
# Digits from which a number that is no card is a candidate.
NUMBER_DIGITS = 12
CONTEXT = 24
# Common top-level domains, country calling codes, card issuers' first digits, words before personal data.
DOMAINS = (
    "com net org edu gov mil info biz io co me app dev ai eu us uk de fr es it nl be at ch se no dk fi pl pt ie ru ua cz gr tr "
    "in cn jp kr au nz ca mx br ar cl za"
).split()
CALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[0-9])"
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|6)"
SPECIAL_NETS = r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^0*192\.0*168\.|^0*169\.0*254\."
WORDS = (
    r"(?i)\b(?:e-?mail|mail|contact|write|call|phone|tel|mobile|fax|card|visa|credit|ip|host|server|addr|address|token|key|api|"
    r"secret|passw(?:or)?d|pwd|login|ssn|iban)\b"
)
LABELERS = ("pattern", "gazetteer", "context", "borders", "shape")
FEATURES = ("kind", "length", "before", "after", "digits", "word", "sign")
SPAN_TYPE = "struct<kind: int, start: int, end: int, base: boolean, votes: array<int>, features: array<int>>"


class PiiModel(NamedTuple):
    """Weight of each value of each feature, and the constant."""

    weights: dict[tuple[int, int], float]
    constant: float
    reliability: dict[str, tuple[float, ...]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(values: Column) -> Column:
    """Sums up to and with each element, by parts of 256, so that long arrays stay cheap."""

    def scan(part: Column) -> Column:
        return F.aggregate(
            part, F.array().cast("array<int>"), lambda a, v: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + v)
        )

    def joined(v: Column) -> Column:
        parts = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 256).cast("int")), lambda i: scan(F.slice(v, i * 256 + 1, F.lit(256)))
        )
        return let(
            parts,
            lambda p: let(
                scan(F.transform(p, lambda x: F.get(x, F.size(x) - 1))),
                lambda t: F.flatten(
                    F.transform(p, lambda x, i: F.transform(x, lambda y: y + F.coalesce(F.get(t, i - 1), F.lit(0))))
                ),
            ),
        )

    return let(values, lambda v: F.when(F.size(v) > 0, joined(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """All matches as ``start``, ``end`` (code points, from 0) and ``text``.

    Splitting by the pattern gives what lies between matches; lengths add up to positions.
    """
    both = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, match: F.struct((F.length(gap) + F.length(match)).alias("step"), match.alias("text")),
    )
    return let(
        F.filter(both, lambda x: x["text"].isNotNull()),
        lambda found: F.zip_with(
            found,
            running_sums(F.transform(found, lambda x: x["step"])),
            lambda x, end: F.struct((end - F.length(x["text"])).alias("start"), end.alias("end"), x["text"].alias("text")),
        ),
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        value = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, value).when(value > 4, value * 2 - 9).otherwise(value * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def strict(kind: str, match: Column) -> Column:
    """Whether a match is one of the strict pattern's."""
    if kind == "ip":
        return match.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$")
    if kind == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(kind == "email")


def _gazetteer(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.substring_index(match, ".", -1)).isin(*DOMAINS), FOR).otherwise(AGAINST)
    if kind == "ip":
        return F.when(match.rlike(SPECIAL_NETS), AGAINST).otherwise(FOR)
    if kind == "card":
        return F.when(match.rlike(ISSUERS), FOR).otherwise(AGAINST)
    if kind == "phone":
        return F.when(match.rlike("^" + CALLING), FOR).otherwise(AGAINST)
    # Lengths of common digests and keys.
    return F.when(F.length(match).isin(18, 20, 24, 32, 36, 40, 48, 64), FOR).otherwise(ABSTAIN)


def _shape(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.when(F.length(F.substring_index(match, "@", 1)).between(2, 64), FOR).otherwise(AGAINST)
    if kind == "ip":
        return F.when(match.rlike(r"^(?:[1-9][0-9]{0,2}\.)"), FOR).otherwise(AGAINST)
    if kind == "card":
        return F.when(match.rlike("^(?:[0-9]{16}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"), FOR).otherwise(ABSTAIN)
    if kind == "phone":
        return F.when(match.rlike("[ ().-]"), FOR).otherwise(ABSTAIN)
    share = F.length(_digits(match)) / F.length(match)
    return F.when(match.rlike("^[0-9a-f]+$") & share.between(0.25, 0.95), FOR).when(share < 0.15, AGAINST).otherwise(ABSTAIN)


def _edge(char: Column) -> Column:
    """0: nothing or space, 1: a letter or digit, 2: another sign."""
    return F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike(r"^[\p{L}\p{N}]"), 1).otherwise(2)


def _span(kind: str, text: Column, found: Column) -> Column:
    """A match with its votes and features."""
    number, match = KINDS.index(kind) if kind in KINDS else len(KINDS), found["text"]
    before = text.substr(F.greatest(found["start"] - CONTEXT, F.lit(0)) + 1, F.least(found["start"], F.lit(CONTEXT)))
    after = text.substr(found["end"] + 1, F.lit(1))
    signs = F.struct(before.alias("before"), _edge(F.right(before, F.lit(1))).alias("left"), _edge(after).alias("right"), strict(kind, match).alias("base"))

    def built(s: Column) -> Column:
        word, sign = s["before"].rlike(WORDS), s["before"].rlike(r"[=:]\s*[\"']?$")
        pattern = F.when(s["base"], FOR).otherwise(AGAINST) if kind in KINDS else F.lit(ABSTAIN)
        context = F.when(word | sign, FOR).when(s["left"] == 1, AGAINST).otherwise(ABSTAIN)
        borders = F.when((s["left"] == 1) | (s["right"] == 1), AGAINST).when((s["left"] == 0) & (s["right"] != 1), FOR).otherwise(ABSTAIN)
        length, share = F.length(match), F.length(_digits(match)) / F.length(match)
        features = (
            F.lit(number) if kind == "secret" else F.when(s["base"], number).otherwise(len(KINDS) + 1),
            F.when(length < 12, 0).when(length < 17, 1).when(length < 33, 2).otherwise(3),
            s["left"],
            s["right"],
            F.when(share < 0.15, 0).when(share < 0.5, 1).when(share < 0.95, 2).otherwise(3),
            word.cast("int"),
            sign.cast("int"),
        )
        return F.struct(
            features[0].cast("int").alias("kind"),
            found["start"].alias("start"),
            found["end"].alias("end"),
            s["base"].alias("base"),
            F.array(*(v.cast("int") for v in (pattern, _gazetteer(kind, match), context, borders, _shape(kind, match)))).alias("votes"),
            F.array(*(f.cast("int") for f in features)).alias("features"),
        )

    return let(signs, built)


def _spans_of(kind: str, text: Column) -> Callable[[Column], Column]:
    return lambda found: _span(kind, text, found)


def candidates(text: Column) -> Column:
    """All proposed spans of a whole text; ``text`` must be a plain column without nulls."""
    empty = F.array().cast(f"array<{SPAN_TYPE}>")
    lists = []
    for kind, pattern in PATTERNS.items():
        found = matches(text, pattern)
        if kind == "card":
            found = F.filter(found, lambda x: F.length(_digits(x["text"])) >= NUMBER_DIGITS)
        spans = F.transform(found, _spans_of(kind, text))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        lists.append(F.when(hint, spans).otherwise(empty))
    return F.concat(*lists)


def fit_pii(found: DataFrame, spans: str) -> PiiModel:
    """Reliabilities and classifier from the candidates of all documents.

    What reaches the driver is one row per combination of votes and features, whose
    number is bounded by their values and not by the data.
    """
    each = found.select(F.explode(spans).alias("s")).groupBy("s.votes", "s.features").agg(F.count(F.lit(1)).alias("n")).collect()
    each.sort(key=lambda r: (r["votes"], r["features"]))
    if not each:
        return PiiModel({}, -1.0, {})
    votes, counts = np.array([r["votes"] for r in each]), np.array([r["n"] for r in each], dtype=float)
    model = fit_votes(votes, counts, prior=0.5)
    weights = np.array(model.weights)
    posterior = 1 / (1 + np.exp(-(model.prior + weights[np.arange(votes.shape[1]), votes].sum(1))))
    cells = sorted({(i, v) for r in each for i, v in enumerate(r["features"])})
    onehot = np.array([[float(r["features"][i] == v) for i, v in cells] for r in each])
    fitted = fit_logistic(onehot, posterior, counts)
    rates = {name: tuple(model.rates[k][1]) for k, name in enumerate(LABELERS)}
    return PiiModel(dict(zip(cells, map(float, fitted[:-1]), strict=True)), float(fitted[-1]), rates)


def probability(span: Column, model: PiiModel) -> Column:
    """The classifier's probability that a span is personal data."""
    rows = [[model.weights.get((i, v), 0.0) for v in range(len(KINDS) + len(EXTRA))] for i in range(len(FEATURES))]
    tables = F.expr(f"array({', '.join(f'array({", ".join(f"{w:.12e}D" for w in row)})' for row in rows)})")
    terms = F.zip_with(span["features"], tables, lambda f, t: F.get(t, f))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.aggregate(terms, F.lit(model.constant), lambda a, w: a + w)))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def decide(spans: Column, model: PiiModel, threshold: float = 0.5) -> Column:
    """Strict spans, and the others that the classifier accepts and that touch no strict one; by kind, then start."""

    def chosen(all_: Column) -> Column:
        base = F.filter(all_, lambda s: s["base"])
        more = F.filter(
            all_, lambda s: ~s["base"] & (probability(s, model) >= threshold) & ~F.exists(base, lambda b: overlaps(b, s))
        )
        kept = F.transform(F.concat(base, more), lambda s: F.struct(s["kind"], s["start"], s["end"], s["base"]))
        return F.array_sort(kept)

    return let(spans, chosen)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, (*KINDS, *EXTRA)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (and spans that overlap it) replaced by its kind in angle brackets."""
    names = F.array(*(F.lit(f"<{n.upper()}>") for n in (*KINDS, *EXTRA)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.concat(text.substr(state["at"] + 1, s["start"] - state["at"]), F.get(names, s["kind"]))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(fresh, F.array_append(state["parts"], gap)).otherwise(state["parts"]).alias("parts"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    return F.aggregate(
        ordered, first, step, lambda end: F.concat(F.array_join(end["parts"], ""), text.substr(end["at"] + 1, F.length(text)))
    )


def find_pii(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: the id and ``spans`` (kind number, start, end, strict or not).

    A null text is an empty one; null ids, repeated rows and an empty table give what
    they hold; other columns are ignored. Positions are code points of the whole
    text. Texts are read once; candidates, without texts, are kept in the shared
    folder.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = materialize(source.select("id", candidates(F.col("text")).alias("found")), "spans")
    model = fit_pii(found, "found")
    return found.select(F.col("id").alias(id_col), decide(F.col("found"), model).alias("spans"))


def mask_documents(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with personal data masked in ``text_col``; other columns, and null texts, stay as they are."""
    whole, found, spans = "__pii_text", "__pii_found", "__pii_spans"
    proposed = candidates(F.col(whole)).alias(found)
    texts = docs.withColumn(whole, F.coalesce(F.col(text_col), F.lit("")))
    model = fit_pii(texts.select(proposed), found)
    decided = texts.select("*", proposed).withColumn(spans, decide(F.col(found), model))
    out = F.when(F.col(text_col).isNotNull(), masked(F.col(whole), F.col(spans)))
    return decided.withColumn(text_col, F.when(F.size(spans) > 0, out).otherwise(F.col(text_col))).drop(whole, found, spans)
