"""URL rules, indexed by their rarest literal token.

A pattern is a host and path written out, with ``||`` for "this host or any
subdomain", ``*`` for any characters and ``^`` for a separator or the end. Its
literal tokens are the letter-digit runs that stand between separators in the
pattern, so every fitting URL holds them as tokens. The index files each rule
under the one token that the fewest URLs hold; a URL looks up its own tokens, and
only the rules found there run their regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from voxledger.session import ship_by_value

ship_by_value(__name__)

VERDICT_TYPE = "struct<rule: string, verdict: string>"
_TOKEN = re.compile(r"[a-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``name`` is reported; rules of a higher ``tier`` win, then longer names, then block over allow."""

    name: str
    pattern: str
    verdict: str
    tier: int = 0


def host_rule(host: str, path: str, verdict: str, tier: int = 1) -> Rule:
    """A rule for a host, its subdomains, and paths with a prefix."""
    return Rule(host + path, f"||{host}{path}", verdict, tier)


def to_regex(pattern: str) -> str:
    """Matched against ``.host`` + ``path``; the leading dot makes a host its own subdomain."""
    head = r"^(?:[^/]*)\." if pattern.startswith("||") else ""
    body = pattern.removeprefix("||")
    return head + "".join(".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)


def literal_tokens(pattern: str) -> list[str]:
    """Letter-digit runs that end at literal separators on both sides."""
    body = (".\0" if pattern.startswith("||") else "*") + pattern.removeprefix("||") + "*"
    body = body.replace("\0", "").lower()
    return [m[0] for m in _TOKEN.finditer(body) if body[m.start() - 1] != "*" and body[m.end()] != "*"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = rest.substr(F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, host: Column, path: Column, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each token of the rules: at most one row per token reaches the driver."""
    wanted = sorted({t for r in rules for t in literal_tokens(r.pattern)})
    if not wanted:
        return {}
    held = F.array_intersect(F.split(F.lower(F.concat(host, path)), "[^a-z0-9]+"), F.array(*map(F.lit, wanted)))
    counted = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in counted}


def index_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest token; those without a usable token are under the empty one."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        tokens = literal_tokens(rule.pattern)
        key = min(tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if tokens else ""
        index.setdefault(key, []).append(number)
    return index


@lru_cache(maxsize=100_000)
def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(to_regex(pattern), re.S)


def best_rule(target: str, rules: Sequence[Rule], index: dict[str, list[int]]) -> Rule | None:
    candidates = [*index.get("", ()), *(n for t in {*_TOKEN.findall(target.lower())} for n in index.get(t, ()))]
    fits = [rules[n] for n in candidates if _compiled(rules[n].pattern).search(target)]
    return max(fits, key=lambda r: (r.tier, len(r.name), r.verdict == "block", r.name), default=None)


def judge_urls(urls: DataFrame, url_col: str, rules: Sequence[Rule], default: str = "allow") -> tuple[Column, Column, Column]:
    """Host, path and ``struct<rule, verdict>`` as columns of ``urls``.

    The winning rule is that of the highest tier, then the longest name. Where none
    fits, ``rule`` is null and the verdict is ``default``; so it is for null and
    malformed URLs, whose host and path are empty. The rule list is the caller's
    and travels with the task; its size does not depend on the data.
    """
    rules = tuple(rules)
    host, path = url_parts(F.col(url_col))
    index = index_rules(rules, token_counts(urls, host, path, rules))

    @arrow_udf(VERDICT_TYPE)
    def decide(targets: pa.Array) -> pa.Array:
        won = [best_rule(t, rules, index) for t in targets.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([r and r.name for r in won], pa.string()), pa.array([r.verdict if r else default for r in won], pa.string())],
            names=["rule", "verdict"],
        )

    return host, path, decide(F.concat(F.lit("."), host, path))
