"""Losses as Columns: loss, gradient and curvature at a prediction. Own losses need the same three methods.

``cells`` has the sums of all three over n rows of one prediction p, from the sum y of their labels; what the labels' spread adds to
the loss (their squares about the mean) counts ``spread`` times. Losses without it are summed row by row.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import bce_with_logits, sigmoid


class Loss(Protocol):
    def loss(self, y: Column, p: Column) -> Column: ...
    def grad(self, y: Column, p: Column) -> Column: ...
    def hess(self, y: Column, p: Column) -> Column: ...


class Square:
    """(y - p)^2."""

    def loss(self, y: Column, p: Column) -> Column:
        return (y - p) * (y - p)

    def grad(self, y: Column, p: Column) -> Column:
        return 2 * (p - y)

    def hess(self, y: Column, p: Column) -> Column:
        return F.lit(2.0) + 0 * p

    def arrays(self, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (y - p) ** 2, 2 * (p - y), np.full_like(p, 2.0)

    spread = 1.0

    def cells(self, y: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return n * (y / n - p) ** 2, 2 * (n * p - y), 2.0 * n + 0 * p


class Logistic:
    """Cross entropy of a logit with a label of 0 or 1."""

    def loss(self, y: Column, p: Column) -> Column:
        return bce_with_logits(p, y)

    def grad(self, y: Column, p: Column) -> Column:
        return sigmoid(p) - y

    def hess(self, y: Column, p: Column) -> Column:
        return sigmoid(p) * (1 - sigmoid(p))

    def arrays(self, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-p))
        return np.maximum(p, 0) - p * y + np.log1p(np.exp(-np.abs(p))), s - y, s * (1 - s)

    spread = 0.0

    def cells(self, y: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-p))
        return n * (np.maximum(p, 0) + np.log1p(np.exp(-np.abs(p)))) - p * y, n * s - y, n * s * (1 - s)
