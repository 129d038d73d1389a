"""Scalar functions as Columns: they stay inside generated code and need no Python on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: eight steps of the recurrence, then Stirling's series (error below 1e-13 of the result)."""
    y = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * F.ln(y) - y + HALF_LOG_2PI + series - F.ln(product)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bce_with_logits(logit: Column, label: Column) -> Column:
    """Binary cross entropy of a logit, stable for large ones."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def softmax_ce(logits: list[Column], label: Column) -> Column:
    """Cross entropy of a class number under the softmax of logits."""
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    total = sum((F.exp(x - top) for x in logits), F.lit(0.0))
    own = F.element_at(F.array(*logits), label.cast("int") + 1)
    return top + F.ln(total) - own


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clipped_inverse(weight: Column, low: float = 0.01, high: float = 1.0) -> Column:
    """Inverse propensity weight within [low, high]."""
    return clip(1 / weight, low, high)


def capped_inverse(p: Column, floor: float = 0.01) -> Column:
    return F.least(1 / p, F.lit(1 / floor))


def floored(p: Column, floor: float = 0.01) -> Column:
    return F.greatest(p, F.lit(floor))


def popularity(mit: Column, gamma: float) -> Column:
    return F.pow(mit, F.lit(gamma))


def merit_ratio(merit: Column, exposure: Column) -> Column:
    """merit / exposure, 1 where that is not a number or there is no exposure."""
    return F.coalesce(F.nanvl(F.try_divide(merit, exposure), F.lit(1.0)), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, sigma: float) -> Column:
    return F.exp(-sqdist(a, b) / (sigma * sigma))


def fm2(rows: Column, width: int) -> Column:
    """Second-order factorisation machine: half of (sum squared minus sum of squares), summed over the width of the rows."""
    zeros = F.array(*[F.lit(0.0)] * width)
    total = F.aggregate(rows, zeros, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    squares = F.aggregate(rows, zeros, lambda s, v: F.zip_with(s, v, lambda x, y: x + y * y))
    return F.aggregate(F.zip_with(total, squares, lambda t, q: 0.5 * (t * t - q)), F.lit(0.0), lambda s, x: s + x)


def not_nan(x: Column) -> Column:
    """x with NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def bin_of(x: Column, bounds: list[float], nan_bin: int | None = None) -> Column:
    """Number of upper bounds below x: bins include their upper bound. NaN and null go to nan_bin, or to the bin of 0."""
    found = F.lit(0)
    low, high = 0, len(bounds)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x <= F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    found = search(low, high - 1) if bounds else F.lit(0)
    missing = F.lit(nan_bin) if nan_bin is not None else F.lit(sum(b < 0 for b in bounds))
    return F.when(x.isNull() | F.isnan(x), missing).otherwise(found)
