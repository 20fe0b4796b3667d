"""Losses as Column expressions, looked up by name.

`value` and `grad` serve the linear learners (labels -1 and 1, or real); `rich` losses give first
and second derivatives for boosting (labels 0..K-1, or real).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as V


@dataclass(frozen=True)
class Loss:
    name: str
    value: Callable[[Column, Column], Column]
    grad: Callable[[Column, Column], Column]


def _logistic_grad(y: Column, s: Column) -> Column:
    return -y / (1 + F.exp(y * s))


LOSSES = {
    "logistic": Loss("logistic", lambda y, s: F.log1p(F.exp(-y * s)), _logistic_grad),
    "hinge": Loss("hinge", lambda y, s: F.greatest(F.lit(0.0), 1 - y * s), lambda y, s: F.when(y * s < 1, -y).otherwise(F.lit(0.0))),
    # the prediction is kept within 20 of zero
    "square": Loss("square", lambda y, s: 0.5 * (s - y) * (s - y), lambda y, s: V.clip(s, -20.0, 20.0) - y),
}


@dataclass(frozen=True)
class RichLoss:
    """Derivatives of scalar scores, and of score vectors with a diagonal second derivative."""

    name: str
    grad: Callable[[Column, Column], Column]
    hess: Callable[[Column, Column], Column]
    grads: Callable[[Column, Column, int], Column]
    hessians: Callable[[Column, Column, int], Column]


def _s(score: Column) -> Column:
    return V.sigmoid(score)


RICH_LOSSES = {
    "logistic": RichLoss(
        "logistic",
        lambda y, s: _s(s) - y,
        lambda y, s: F.greatest(_s(s) * (1 - _s(s)), F.lit(V.EPSILON)),
        lambda y, s, k: F.zip_with(V.softmax(s), V.one_hot(y, k), lambda p, t: p - t),
        lambda y, s, k: F.transform(V.softmax(s), lambda p: F.greatest(p * (1 - p), F.lit(V.EPSILON))),
    ),
    "square": RichLoss(
        "square",
        lambda y, s: s - y,
        lambda y, s: F.lit(1.0),
        lambda y, s, k: F.zip_with(s, V.one_hot(y, k), lambda p, t: p - t),
        lambda y, s, k: F.transform(s, lambda p: F.lit(1.0)),
    ),
}


def full_hessian(score: Column) -> Column:
    """Lower triangle, row by row, of the soft-max second derivative."""
    p = V.softmax(score)
    n = F.size(score)
    row = lambda i: F.transform(F.sequence(F.lit(0), i), lambda j: F.when(i == j, F.greatest(F.get(p, i) * (1 - F.get(p, i)), F.lit(V.EPSILON))).otherwise(-F.greatest(F.get(p, i) * F.get(p, j), F.lit(V.EPSILON))))
    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), row))


def loss(name: str) -> Loss:
    if name not in LOSSES:
        raise ValueError(f"no such loss: {name}")
    return LOSSES[name]


def rich_loss(name: str) -> RichLoss:
    if name not in RICH_LOSSES:
        raise ValueError(f"no such loss: {name}")
    return RICH_LOSSES[name]
