"""The normal distribution as column expressions and as SQL text, as neither Spark SQL nor the SQL of the twins has it.

Both texts come from one recipe: a rational approximation of the distribution function that is good to double precision
(Hart's coefficients) and one of its inverse that is good to nine digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients from the highest power down.
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_TAIL, _ROOT_2PI = 7.07106781186547, 2.506628274631


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    text = f"{coefficients[0]!r}"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r})"
    return text


def cdf_sql(x: str) -> str:
    """P(Z <= x), in SQL that Spark and the twins' engine share; null for null."""
    a = f"least(abs(CAST({x} AS DOUBLE)), 37e0)"
    num, den = (_horner(a, tuple(c)) for c in (_NUM, _DEN))
    far = f"({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0)))))"
    tail = f"exp(-{a} * {a} / 2e0) * (CASE WHEN {a} < {_TAIL} THEN {num} / {den} ELSE 1e0 / ({far} * {_ROOT_2PI}e0) END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1e0 - {tail} ELSE {tail} END)"


def cdf(x: str) -> Column:
    """P(Z <= x) of a column or SQL expression named by text."""
    return F.expr(cdf_sql(x))


def cdf_array(x: np.ndarray) -> np.ndarray:
    """:func:`cdf_sql` of an array of doubles; NaN for NaN."""
    a = np.minimum(np.abs(x), 37.0)
    num, den = (np.full_like(a, c[0]) for c in (_NUM, _DEN))
    for total, coefficients in ((num, _NUM), (den, _DEN)):
        for c in coefficients[1:]:
            total *= a
            total += c
    num /= den
    if len(far := np.flatnonzero(a >= _TAIL)):
        b = a[far]
        num[far] = 1.0 / ((b + 1.0 / (b + 2.0 / (b + 3.0 / (b + 4.0 / (b + 0.65))))) * _ROOT_2PI)
    num *= np.exp(-a * a / 2.0)
    return np.where(x > 0, 1.0 - num, num)


#: The inverse's central and tail coefficients, from the highest power down.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661413742e00, 1.0)
_LOW = 0.02425


def ppf_sql(p: str) -> str:
    """The quantile of the normal distribution at p, null outside (0, 1)."""
    mid = f"(({p}) - 0.5e0)"
    square = f"({mid} * {mid})"
    low, high = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - ({p})))"
    tail = lambda q: f"{_horner(q, _C)} / {_horner(q, _D)}"
    return (
        f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < {_LOW} THEN {tail(low)} WHEN ({p}) > {1 - _LOW} THEN -{tail(high)} "
        f"ELSE {_horner(square, _A)} * {mid} / {_horner(square, _B)} END)"
    )


def ppf(p: str) -> Column:
    return F.expr(ppf_sql(p))
