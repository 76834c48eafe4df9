"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them.

What is fitted is the table of vote patterns with their counts, which Spark makes
from all rows. With r rules it has at most 3^r rows, whatever the data's size.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A vote: against, for, or none.
AGAINST, FOR, ABSTAIN = 0, 1, 2


class VoteModel(NamedTuple):
    """Log odds before any vote, and what each rule's vote adds: ``weights[rule][vote]``."""

    prior: float
    weights: tuple[tuple[float, float, float], ...]
    rates: tuple[tuple[tuple[float, ...], tuple[float, ...]], ...]

    def log_odds(self, votes: Sequence[Column]) -> Column:
        out = F.lit(self.prior)
        for vote, weights in zip(votes, self.weights, strict=True):
            out = out + F.element_at(F.array(*map(F.lit, weights)), vote.cast("int") + 1)
        return out

    def probability(self, votes: Sequence[Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(votes)))


def pattern_counts(rows: DataFrame, votes: Sequence[Column]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct vote patterns (at most 3^r) and how many rows have each."""
    names = [f"v{i}" for i in range(len(votes))]
    found = rows.select(*(v.cast("int").alias(n) for v, n in zip(votes, names, strict=True))).groupBy(*names).count().collect()
    found.sort()
    return np.array([r[:-1] for r in found], dtype=int).reshape(-1, len(names)), np.array([r[-1] for r in found], dtype=float)


def fit_votes(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.7, rounds: int = 200, smoothing: float = 1.0) -> VoteModel:
    """Expectation-maximisation over two hidden classes.

    Each rule has, per class, the rates of its three votes. The start says that
    rules are right more often than not, which decides which class is which; a
    rule can still turn out worthless, but the classes are not swapped: where the
    fit ends with most rules pointing backwards, the start's rates are returned.
    """
    rules = patterns.shape[1]
    onehot = np.zeros((len(patterns), rules, 3))
    if len(patterns):
        onehot[np.arange(len(patterns))[:, None], np.arange(rules)[None, :], patterns] = 1
    spread = np.einsum("p,prv->rv", counts, onehot) + 1
    spread /= spread.sum(1, keepdims=True)
    tilt = np.array([[4.0, 1.0, 2.0], [1.0, 4.0, 2.0]])
    start = spread[None] * tilt[:, None, :]
    start /= start.sum(2, keepdims=True)
    rates, share = start, prior
    for _ in range(rounds):
        logs = np.einsum("prv,crv->pc", onehot, np.log(rates)) + np.log([1 - share, share])
        top = logs.max(1, keepdims=True) if len(logs) else logs
        belief = np.exp(logs - top)
        belief = belief / belief.sum(1, keepdims=True) if len(belief) else belief
        mass = np.einsum("p,pc,prv->crv", counts, belief, onehot) + smoothing * start
        new = mass / mass.sum(2, keepdims=True)
        moved = np.abs(new - rates).max()
        rates = new
        share = float(np.clip(((counts * belief[:, 1]).sum() + prior) / (counts.sum() + 1), 0.001, 0.999))
        if moved < 1e-7:
            break
    gain = np.log(rates[1]) - np.log(rates[0])
    if np.sum(gain[:, FOR] - gain[:, AGAINST] > 0) * 2 < rules:
        rates, share = start, prior
        gain = np.log(rates[1]) - np.log(rates[0])
    return VoteModel(
        float(np.log(share / (1 - share))),
        tuple(tuple(map(float, g)) for g in gain),
        tuple((tuple(map(float, rates[0][r])), tuple(map(float, rates[1][r]))) for r in range(rules)),
    )


def fit_logistic(features: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; targets may be probabilities. The last coefficient is the constant."""
    x = np.hstack([features, np.ones((len(features), 1))])
    out = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ out, -30, 30)))
        slope = x.T @ (weight * (p - target)) + penalty * out
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        out = out - step
        if np.abs(step).max() < 1e-6:
            break
    return out
