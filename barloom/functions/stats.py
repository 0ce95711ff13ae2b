"""The normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximations of the normal distribution and its inverse.
_CDF_P = 0.2316419
_CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_TAIL = 0.02425
_INV_A = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
_INV_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
_INV_C = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
_INV_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    """Highest power first."""
    y = F.lit(0.0)
    for k in coefficients:
        y = y * x + k
    return y


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + F.abs(x) * _CDF_P)
    upper = F.exp(x * x * -0.5) / math.sqrt(2 * math.pi) * t * _polynomial(t, _CDF_B[::-1])
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def probit(p: Column) -> Column:
    """The inverse of the distribution; infinite at and beyond 0 and 1."""
    tail = lambda q: _polynomial(q, _INV_C) / _polynomial(q, _INV_D)
    q = p - 0.5
    middle = q * _polynomial(q * q, _INV_A) / _polynomial(q * q, _INV_B)
    root = lambda x: F.sqrt(F.log(F.greatest(x, F.lit(1e-300))) * -2)
    out = F.when(p < _TAIL, tail(root(p))).when(p <= 1 - _TAIL, middle).otherwise(-tail(root(1 - p)))
    return F.when(p <= 0, F.lit(float("-inf"))).when(p >= 1, F.lit(float("inf"))).otherwise(out)
