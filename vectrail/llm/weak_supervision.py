"""Weak supervision: reliabilities of voting rules by expectation-maximisation.

Rules vote 1, 0 or abstain (-1). Rows are counted by their pattern of votes in
Spark; there are at most 3 ** rules patterns however many rows there are, and only
these counts reach the driver. The model is naive Bayes with a hidden binary class:
each rule has a chance of each vote in each class, abstaining included.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES = (1, 0, -1)
#: Pseudo-counts that keep every chance off 0 and 1.
SMOOTHING = 1.0


@dataclass(frozen=True)
class VoteModel:
    """``log_odds[rule][vote]`` is what a vote adds to the log-odds of class 1; ``bias`` is the prior's."""

    rules: tuple[str, ...]
    bias: float
    log_odds: dict[str, dict[int, float]]
    accuracy: dict[str, float]

    def posterior(self, votes: dict[str, int]) -> float:
        z = self.bias + sum(self.log_odds[r][votes[r]] for r in self.rules)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

    def score(self, vote: dict[str, Column] | None = None) -> Column:
        """Posterior probability of class 1 from the rules' vote columns."""
        z = F.lit(self.bias)
        for r in self.rules:
            v, odds = vote[r] if vote else F.col(r), self.log_odds[r]
            z = z + F.when(v == 1, odds[1]).when(v == 0, odds[0]).otherwise(odds[-1])
        return 1 / (1 + F.exp(-z))


def pattern_counts(votes: DataFrame, rules: list[str]) -> list[tuple[tuple[int, ...], int]]:
    """(votes, rows) of every pattern that occurs."""
    found = votes.groupBy(*rules).agg(F.count("*").alias("n")).collect()
    return sorted((tuple(r[x] for x in rules), r["n"]) for r in found)


def fit(
    counts: list[tuple[tuple[int, ...], int]],
    rules: list[str],
    prior: float,
    false_alarms: float = 0.2,
    rounds: int = 100,
    least_prior: float = 0.05,
) -> VoteModel:
    """EM for rules whose votes for the rarer class are each believed at first.

    ``prior`` is the first guess of class 1's share, and ``false_alarms`` of how
    often each rule votes for the rarer class on the other one, as a share of how
    often it does so overall; it misses many of the rarer class, as each rule knows
    one kind. The prior stays within ``least_prior`` of 0 and 1, and a vote never
    comes to count against what it says. Without rows the first guess is the model.
    """
    total = sum(n for _, n in counts)
    share = {r: {v: SMOOTHING for v in VOTES} for r in rules}
    for pattern, n in counts:
        for r, v in zip(rules, pattern, strict=True):
            share[r][v] += n
    rare = 0 if prior >= 0.5 else 1
    common = max(prior, 1 - prior)
    # chance[rule][class][vote]
    chance = {}
    for r in rules:
        said = {v: share[r][v] / sum(share[r].values()) for v in VOTES}
        alarm = {1 - rare: said[rare] * false_alarms}
        alarm[rare] = min(0.9, (said[rare] - common * alarm[1 - rare]) / (1 - common))
        # what is no alarm is split as it is overall
        quiet = {v: said[v] / (1 - said[rare]) for v in VOTES if v != rare}
        chance[r] = {c: {rare: alarm[c]} | {v: (1 - alarm[c]) * x for v, x in quiet.items()} for c in (0, 1)}

    def odds(r: str, v: int) -> float:
        x = math.log(chance[r][1][v]) - math.log(chance[r][0][v])
        return max(x, 0.0) if v == 1 else min(x, 0.0) if v == 0 else 0.0

    bias = math.log(prior / (1 - prior))
    for _ in range(rounds if total else 0):
        table = {r: {v: odds(r, v) for v in VOTES} for r in rules}
        weight = {r: {c: {v: SMOOTHING for v in VOTES} for c in (0, 1)} for r in rules}
        ones = 0.0
        for pattern, n in counts:
            z = bias + sum(table[r][v] for r, v in zip(rules, pattern, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            ones += n * p
            for r, v in zip(rules, pattern, strict=True):
                weight[r][1][v] += n * p
                weight[r][0][v] += n * (1 - p)
        for r in rules:
            for c in (0, 1):
                whole = sum(weight[r][c].values())
                chance[r][c] = {v: weight[r][c][v] / whole for v in VOTES}
        prior = min(max(ones / total, least_prior), 1 - least_prior)
        moved, bias = abs(math.log(prior / (1 - prior)) - bias), math.log(prior / (1 - prior))
        if moved < 1e-9:
            break
    accuracy = {}
    for r in rules:
        right = prior * chance[r][1][1] + (1 - prior) * chance[r][0][0]
        wrong = prior * chance[r][1][0] + (1 - prior) * chance[r][0][1]
        accuracy[r] = right / (right + wrong)
    return VoteModel(tuple(rules), bias, {r: {v: odds(r, v) for v in VOTES} for r in rules}, accuracy)
