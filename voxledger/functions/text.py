"""Text cleanup as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxledger.session import ship_by_value

ship_by_value(__name__)

# Every character that counts as white space, as a trim list and as a pattern class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# What cleanup removes.
TAG = r"<[^>]+>"
LINK = rf"https?://[^{WS}]+|www\.[^{WS}]+"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+"
# Runs of white space; a single plain space is left alone, as it would become itself.
SPACES = rf" [{WS}]+|[{WS}&&[^ ]][{WS}]*"
POST_BODY = r"(?s)<!-- SC_OFF -->(.*?)<!-- SC_ON -->"
BODY_LINKS = r"(?i)\[link\]|\[comments\]"
BODY_FOOTER = r"(?id)submitted by.*"
LETTER_OR_DIGIT = r"\p{L}\p{N}"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACES, " "))


def _if(condition: Column, text: Column, pattern: str) -> Column:
    """Replace matches by a space where the condition holds; the text is computed once."""
    replaced = F.transform(
        F.array(text), lambda t: F.when(condition, F.regexp_replace(t, F.lit(pattern), F.lit(" "))).otherwise(t)
    )
    return F.get(replaced, F.lit(0))


def clean_text(raw: Column) -> Column:
    """Drop markup, links and emoji, then collapse white space; null gives ''.

    Removing one kind never creates another, so cheap looks at the raw text
    tell which patterns can match at all.
    """
    text = _if(raw.contains("<"), raw, TAG)
    text = _if(raw.contains("://") | raw.contains("www."), text, LINK)
    text = _if(F.octet_length(raw) != F.char_length(raw), text, EMOJI)
    return F.coalesce(collapse(text), F.lit(""))


def clean_text_once(raw: Column) -> Column:
    """``clean_text`` for a select that is filtered by its result afterwards.

    Catalyst moves a filter below a projection by repeating the expression in
    it, which would clean every text twice. It does not move one below explode.
    """
    return F.explode(F.array(clean_text(raw)))


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """Decode HTML entities; the named-entity table has no built-in counterpart."""
    return text.map(html.unescape, na_action="ignore")


def post_body(content: Column) -> Column:
    """Readable text of a post between its body markers; '' when there is none."""
    block = F.regexp_extract(F.coalesce(content, F.lit("")), POST_BODY, 1)
    plain = F.regexp_replace(block, TAG, " ")
    # Only texts that hold an ampersand are sent to Python.
    text = F.coalesce(unescape_entities(F.when(plain.contains("&"), plain)), plain)
    text = F.regexp_replace(text, BODY_LINKS, "")
    text = F.regexp_replace(text, BODY_FOOTER, "")
    return collapse(text)


def external_id(raw_id: Column, prefix: str = "reddit_") -> Column:
    """Stable id of a post: last path segment without its kind marker."""
    last = F.element_at(F.split(F.coalesce(raw_id, F.lit("")), "/"), -1)
    return F.concat(F.lit(prefix), F.replace(last, F.lit("t3_"), F.lit("")))


def merge_title_body(title: Column, body: Column) -> Column:
    head = strip(F.coalesce(title, F.lit("")))
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(head, F.lit(" - "), body)).otherwise(head)


def truncate(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def has_words(clean: Column, count: int) -> Column:
    """At least ``count`` words, a word being a token with a letter or digit.

    The match stops at the last word it needs and never goes back.
    """
    other, word = rf"[^{LETTER_OR_DIGIT}]*+", rf"[{LETTER_OR_DIGIT}]"
    return clean.rlike(rf"^(?:{other}{word}[^ ]*+ ){{{count - 1}}}{other}{word}")


def mentions(raw: Column) -> Column:
    counted = F.regexp_count(raw, F.lit(r"(?U)@\w+"))
    return F.when(raw.contains("@"), counted).otherwise(0)
