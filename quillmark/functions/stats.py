"""Rates, intervals and small statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def safe_rate(numerator: Column, denominator: Column) -> Column:
    """Ratio as double, 0.0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def count_true(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def wilson_halfwidth(rate: Column, n: Column, z: float = Z) -> Column:
    """Half of the Wilson interval's width; NaN without observations."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    spread = F.sqrt(rate * (1 - rate) / m + F.lit(z * z / 4) / (m * m))
    return F.when(n > 0, F.lit(z) * spread / (1 + F.lit(z * z) / m)).otherwise(F.lit(math.nan))


def pct(rate: Column, n: Column) -> Column:
    """``12.3% ±4.5``, or ``n/a`` without observations."""
    half = wilson_halfwidth(rate, n)
    return F.when(n > 0, F.format_string("%.1f%% ±%.1f", rate * 100, half * 100)).otherwise("n/a")


def pearson(x: str, y: str) -> Column:
    """Correlation aggregate; null under three rows or if a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.count_if(both) >= 3, r)


def composite(retrieval: Column, groundedness: Column, agreement: Column, weights: tuple[float, float, float] = (0.3, 0.4, 0.3)) -> Column:
    return weights[0] * retrieval + weights[1] * groundedness + weights[2] * agreement


def should_abstain(signal: Column, threshold: float | Column) -> Column:
    """Strictly below: a signal at the threshold answers."""
    return signal < threshold


def retrieval_confidence(scores: Column) -> Column:
    """From the scores in rank order: 0 for none, 1 for one, else the first gap's share of the spread."""
    first, second, last = F.get(scores, F.lit(0)), F.get(scores, F.lit(1)), F.element_at(scores, -1)
    spread = first - last
    return (F.when(F.size(scores) <= 0, 0.0).when(F.size(scores) == 1, 1.0)
            .when(spread <= 0, 0.5).otherwise(F.try_divide(first - second, spread)))


def agreement_score(all_abstained: Column, any_abstained: Column, overlap: Column) -> Column:
    return F.when(all_abstained, 1.0).when(any_abstained, 0.0).otherwise(overlap)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))


def pairwise_jaccard(sets: Column) -> Column:
    """Mean over unordered pairs of an array of arrays; under two sets 1."""
    n = F.size(sets)
    pairs = F.flatten(F.transform(sets, lambda a, i: F.transform(
        F.filter(sets, lambda _, j: j > i), lambda b: jaccard(a, b))))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when(n < 2, 1.0).otherwise(F.try_divide(total, n * (n - 1) / 2))


def answerability(verdict: Column) -> Column:
    """Unknown verdicts score 0: the gate fails closed."""
    return F.when(verdict == "ANSWERABLE", 1.0).when(verdict == "PARTIAL", 0.5).otherwise(0.0)
