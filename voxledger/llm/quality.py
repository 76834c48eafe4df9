"""Quality rules under weak supervision.

Rules look at counts of a whole text and vote for it, against it, or abstain.
Expectation-maximisation over the vote patterns of all documents estimates how
far each vote can be trusted; a document stays if its posterior probability of
being good is at least one half. No rule alone rejects a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from voxledger.llm.weak_labels import ABSTAIN, AGAINST, FOR, VoteModel, fit_votes, pattern_counts
from voxledger.session import ship_by_value

ship_by_value(__name__)

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_letters", "n_digits", "n_distinct", "n_stops", "n_ends")
STATS_TYPE = StructType([StructField(name, LongType()) for name in (*BASE, *EXTRA)])
# Frequent function words of English, French, German and Spanish.
STOPS = frozenset(
    b"a al an and are as at au aus avec be but by con da das de del dem den der des die dans du e ein eine el en er es est et for "
    b"from hat he in is ist it la las le les los mit nicht not of on ou par pas pour que qui se sich sie son su sur that the this "
    b"to un una und une von war was with y zu".split()
)


def _repeats(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``BASE`` and ``EXTRA``."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    distinct = set(words)
    upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _UPPER))
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _LETTERS))
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        len(raw) - len(raw.translate(None, SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        _repeats(words),
        len(lines),
        upper,
        letters,
        len(raw) - len(raw.translate(None, b"0123456789")),
        len(distinct),
        sum(w in STOPS for w in raw.lower().split()),
        sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines),
    )


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower()


@arrow_udf(STATS_TYPE)
def text_stats(texts: pa.Array) -> pa.Array:
    rows = [measure(t or "") for t in texts.to_pylist()]
    names = (*BASE, *EXTRA)
    columns = np.array(rows, dtype=np.int64).reshape(-1, len(names)).T
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(names))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def rule_votes(s: Column) -> dict[str, Column]:
    """The rules' votes on the counts of a text; a text without words only gets the length vote."""
    words, some = s["n_words"], s["n_words"] > 0

    def share(part: str, of: str) -> Column:
        return s[part] / F.greatest(s[of], F.lit(1))

    def rule(value: Column, poor: float, good: float) -> Column:
        up = good >= poor
        against = value < poor if up else value > poor
        favour = value >= good if up else value <= good
        return F.when(~some, ABSTAIN).when(against, AGAINST).when(favour, FOR).otherwise(ABSTAIN)

    mean = share("word_chars", "n_words")
    return {
        "long_enough": F.when(words < 50, AGAINST).when(words >= 100, FOR).otherwise(ABSTAIN),
        "word_length": F.when(~some, ABSTAIN).when((mean < 2.5) | (mean > 12), AGAINST).when((mean >= 3) & (mean <= 10), FOR).otherwise(ABSTAIN),
        "few_symbols": rule(share("n_symbols", "n_words"), 0.2, 0.02),
        "few_dup_lines": rule(share("n_dup_lines", "n_lines"), 0.3, 0.1),
        "few_repeats": rule(share("n_repeat_words", "n_words"), 0.3, 0.1),
        "few_capitals": rule(share("n_upper", "n_letters"), 0.4, 0.15),
        "letters": rule(share("n_letters", "word_chars"), 0.75, 0.9),
        "few_digits": rule(share("n_digits", "word_chars"), 0.25, 0.05),
        "stop_words": rule(share("n_stops", "n_words"), 0.03, 0.1),
        "varied_words": rule(share("n_distinct", "n_words"), 0.1, 0.25),
        "line_ends": rule(share("n_ends", "n_lines"), 0.1, 0.4),
    }


def fit_quality(stats: DataFrame, stats_col: str) -> VoteModel:
    """Learn the rules' reliabilities from the counts of all rows."""
    return fit_votes(*pattern_counts(stats, list(rule_votes(F.col(stats_col)).values())))


def quality_probability(s: Column, model: VoteModel) -> Column:
    return model.probability(list(rule_votes(s).values()))


def judge(s: Column, model: VoteModel, threshold: float = 0.5) -> Column:
    """Kept or not: false for a text that fails the base rules, else the posterior's verdict."""
    return ~base_failed(s) & (quality_probability(s, model) >= threshold)
