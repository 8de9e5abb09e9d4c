"""Tail probabilities needed after an aggregation, on single numbers."""

from __future__ import annotations

import math


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula, without the cancellation of large terms."""
    if n <= 15:
        return math.lgamma(n + 1.0) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by its series where x is near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, power, j = (x - mean) * v, 2 * x * v, 1
    while True:
        power *= v * v
        step = total + power / (2 * j + 1)
        if step == total:
            return total
        total, j = step, j + 1


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction.

    The factor before the fraction is a binomial density in its saddle-point form
    (Loader 2000), which keeps its digits for any number of rows.
    """
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, 1.0 - x)
    n = a + b
    exponent = (
        _stirling_error(n) - _stirling_error(a) - _stirling_error(b) - _deviance(a, n * x) - _deviance(b, n * (1.0 - x))
    )
    front = b / n * math.exp(exponent) * math.sqrt(n / (2 * math.pi * a * b))
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    # The fraction settles after some multiple of the root of n terms.
    for m in range(1, 1000 + 20 * int(math.sqrt(n))):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            change = c * d
            value *= change
        if abs(change - 1.0) < 1e-15:
            break
    else:
        raise ArithmeticError("the continued fraction did not settle")
    return front * value


def student_two_sided(t: float, freedom: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_share(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def binomial_at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p)."""
    return 1.0 if k <= 0 else beta_share(k, n - k + 1, p)


def _solve(rising, level: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if rising(middle) < level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def exact_interval(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson interval of a share of k in n."""
    tail = (1.0 - confidence) / 2.0
    low = 0.0 if k == 0 else _solve(lambda p: binomial_at_least(k, n, p), tail)
    high = 1.0 if k == n else _solve(lambda p: binomial_at_least(k + 1, n, p), 1.0 - tail)
    return low, high
