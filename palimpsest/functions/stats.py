"""Statistics as columns."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the Chebyshev fit of the complementary error function
# (relative error below 1.2e-7 for every argument), highest power last.
ERFC_COEFFICIENTS = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def erfc(x: Column) -> Column:
    t = 1.0 / (1.0 + 0.5 * F.abs(x))
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2.0 - tail)


def two_sided_p(z: Column) -> Column:
    """P(|Z| >= |z|) of a standard normal."""
    return F.least(erfc(F.abs(z) / F.sqrt(F.lit(2.0))), F.lit(1.0))


def exact_signed_rank(limit: int = 50) -> list[tuple[int, float, float]]:
    """(n, w, two-sided p) of the signed-rank statistic without ties, for n up to `limit`.

    Counts subsets of 1..n by their sum; the table is built from this rule, not stored.
    """
    rows, counts = [], [1]
    for n in range(1, limit + 1):
        grown = counts + [0] * n
        for total in range(len(counts)):
            grown[total + n] += counts[total]
        counts, below = grown, 0
        for w in range(len(counts) // 2 + 1):
            below += counts[w]
            rows.append((n, float(w), min(1.0, 2.0 * below / 2.0**n)))
    return rows


#: Fixed value: the 97.5 % point of the normal distribution.
Z975 = 1.959963984540054


def mean_interval(value: Column) -> tuple[Column, Column]:
    """Aggregates: the 2.5 and 97.5 percentiles of the mean of n rows drawn with replacement from a group of n.

    That mean has known cumulants (those of the group over powers of n), and its percentiles follow from the first four by the
    Cornish-Fisher expansion. One rule and one pass for groups of every size; nothing is drawn. Limits stay within the values.
    """
    n, mean, variance = F.count(value), F.avg(value), F.var_pop(value)
    skew = F.nanvl(F.skewness(value), F.lit(0.0)) / F.sqrt(n)
    excess = F.nanvl(F.kurtosis(value), F.lit(0.0)) / n

    def limit(z: float) -> Column:
        at = z + (z * z - 1) / 6 * skew + (z**3 - 3 * z) / 24 * excess - (2 * z**3 - 5 * z) / 36 * skew * skew
        found = mean + F.sqrt(variance / n) * at
        return F.when(variance > 0, F.least(F.greatest(found, F.min(value)), F.max(value))).otherwise(mean)

    return limit(-Z975), limit(Z975)


def binomial_tail(n: int, m: int, x: float) -> float:
    """P(at least m of n) for n draws of chance x: the regularised incomplete beta function, by its continued fraction."""
    if m <= 0 or x >= 1.0:
        return 1.0
    if x <= 0.0 or m > n:
        return 0.0
    a, b = float(m), float(n - m + 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _fraction(b, a, 1.0 - x)
    return _fraction(a, b, x)


def _fraction(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    value, k = d, 0
    while True:
        k += 1
        for step in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-13:
            return min(1.0, front * value)


@lru_cache(maxsize=4096)
def rank_of_middle(n: int, m: int, p: float) -> int:
    """The smallest rank r of n such that the m-th smallest of n draws with replacement is at most the value of rank r with a
    chance of p at least."""
    z = -Z975 if p < 0.5 else Z975
    guess, step = m + z * math.sqrt(n) / 2, 1
    low = high = min(n, max(1, round(guess)))
    while low > 1 and binomial_tail(n, m, low / n) >= p:
        low, step = max(1, low - step), 2 * step
    step = 1
    while high < n and binomial_tail(n, m, high / n) < p:
        high, step = min(n, high + step), 2 * step
    while low < high:
        middle = (low + high) // 2
        if binomial_tail(n, m, middle / n) >= p:
            high = middle
        else:
            low = middle + 1
    return low
