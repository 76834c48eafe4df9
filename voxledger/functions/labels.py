"""Turn model answers into safe labels, entirely as column expressions.

Answers are parsed into ``variant`` so that the JSON type of every field is
still known: ``4.7`` and ``"4.7"`` are different urgencies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxledger import schema as S
from voxledger.functions.text import strip

LABEL_TYPE = "struct<category:string,sentiment:string,urgency_score:int>"
LABELS_TYPE = f"array<{LABEL_TYPE}>"

# Code fences around an answer, and text that reads as an integer.
FENCE_OPEN = r"^```(json)?"
FENCE_CLOSE = r"```$"
OUTER_OBJECT = r"(?s)\{.*\}"
OUTER_ARRAY = r"(?s)\[.*\]"
INTEGER_TEXT = r"(?U)^[\s\x1c-\x1f]*[+-]?[0-9]+(_[0-9]+)*[\s\x1c-\x1f]*$"


def fallback_label() -> Column:
    return F.struct(
        F.lit(S.FALLBACK_CATEGORY).alias("category"),
        F.lit(S.FALLBACK_SENTIMENT).alias("sentiment"),
        F.lit(S.FALLBACK_URGENCY).cast("int").alias("urgency_score"),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _payload(answer: Column, outermost: str) -> Column:
    text = strip(F.regexp_replace(strip(answer), FENCE_OPEN, ""))
    text = strip(F.regexp_replace(text, FENCE_CLOSE, ""))
    return _let(text, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, outermost, 0), F.lit("")), t))


def _parse_one(text: Column) -> Column:
    """Variant of a text that is exactly one JSON value, else null.

    The parser stops after the first value; wrapping the text in an array
    makes anything behind that value visible.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return _let(items, lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))


def parse_object(answer: Column) -> Column:
    """The outermost object of an answer as a variant; null when it does not parse."""
    return _let(_parse_one(_payload(answer, OUTER_OBJECT)), lambda value: F.when(_is_object(value), value))


def parse_array(answer: Column) -> Column:
    """The outermost array of an answer as ``array<variant>``; null when it does not parse."""
    value = _parse_one(_payload(answer, OUTER_ARRAY))
    return F.try_variant_get(value, "$", "array<variant>")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _nested(value: Column, field: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    return F.coalesce(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(False))


def is_unusable(value: Column) -> Column:
    """True when one element spoils its whole answer: not an object, a list or
    object in place of a label, or an infinite urgency."""
    number = F.try_variant_get(value, "$.urgency_score", "double")
    kind = F.schema_of_variant(F.try_variant_get(value, "$.urgency_score", "variant"))
    infinite = F.coalesce((kind == "DOUBLE") & (F.abs(number) == F.lit(float("inf"))), F.lit(False))
    return ~_is_object(value) | _nested(value, "category") | _nested(value, "sentiment") | infinite


def _urgency(value: Column) -> Column:
    return _let(
        F.schema_of_variant(F.try_variant_get(value, "$.urgency_score", "variant")),
        lambda kind: _urgency_of_kind(value, kind),
    )


def _urgency_of_kind(value: Column, kind: Column) -> Column:
    text = F.try_variant_get(value, "$.urgency_score", "string")
    number = F.when(
        kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"),
        F.try_variant_get(value, "$.urgency_score", "double"),
    ).when(
        (kind == "STRING") & text.rlike(INTEGER_TEXT),
        F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("double"),
    )
    clamped = F.greatest(F.lit(float(S.MIN_URGENCY)), F.least(F.lit(float(S.MAX_URGENCY)), number))
    # The cast truncates towards zero, after the clamp has removed large values.
    return F.when(number.isNotNull(), clamped.cast("int")).otherwise(F.lit(S.FALLBACK_URGENCY))


def validate(value: Column) -> Column:
    """Labels of one parsed object, each replaced by its default when outside its domain."""
    category = F.try_variant_get(value, "$.category", "string")
    sentiment = F.try_variant_get(value, "$.sentiment", "string")
    return F.struct(
        F.when(category.isin(*S.CATEGORIES), category).otherwise(S.FALLBACK_CATEGORY).alias("category"),
        F.when(sentiment.isin(*S.SENTIMENTS), sentiment).otherwise(S.FALLBACK_SENTIMENT).alias("sentiment"),
        _urgency(value).cast("int").alias("urgency_score"),
    )


def labels_from_object(answer: Column) -> Column:
    """Labels for a one-row answer; the fallback when anything is wrong with it."""

    def labels(value: Column) -> Column:
        usable = F.coalesce(~is_unusable(value), F.lit(False))
        return F.when(usable, validate(value)).otherwise(fallback_label())

    return _let(parse_object(answer), labels)


def labels_from_array(answer: Column) -> Column:
    """Labels for a batch answer as an array, or null when the batch as a whole failed."""

    def labels(items: Column) -> Column:
        usable = F.coalesce(~F.exists(items, is_unusable), F.lit(False))
        return F.when(usable, F.transform(items, validate))

    return _let(parse_array(answer), labels)
