"""Evaluation metrics: each is a Column for one row, and a data set's value is its average.

`precision` is the share of right decisions and `error` its complement; a score of zero or more
decides for the positive class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V

Metric = Callable[[Column, Column], Column]


def _share(good: Column) -> Column:
    return F.when(good, F.lit(1.0)).otherwise(F.lit(0.0))


def _log_loss_01(y: Column, s: Column) -> Column:
    p = V.sigmoid(s)
    return F.when(y == 1, -F.log(F.greatest(p, F.lit(V.LARGER_EPSILON)))).otherwise(-F.log(F.greatest(1 - p, F.lit(V.LARGER_EPSILON))))


# Labels 0 and 1.
BINARY: dict[str, Metric] = {
    "mse": lambda y, s: (s - y) * (s - y),
    "error": lambda y, s: _share((s >= 0) != (y == 1)),
    "precision": lambda y, s: _share((s >= 0) == (y == 1)),
    "log-loss": _log_loss_01,
}

# Labels -1 and 1.
SIGNED: dict[str, Metric] = {
    "mse": BINARY["mse"],
    "error": lambda y, s: _share(y * s < 0),
    "precision": lambda y, s: _share(y * s >= 0),
    "log-loss": lambda y, s: F.log1p(F.exp(-y * s)),
    "hinge-loss": lambda y, s: F.greatest(F.lit(0.0), 1 - y * s),
}


def _at(xs: Column, y: Column) -> Column:
    return F.get(xs, y.cast("int"))


# Score vectors, labels 0..K-1.
MULTI: dict[str, Metric] = {
    # summed over the classes
    "mse": lambda y, s: V.total(s_sq(s)) - 2 * _at(s, y) + 1,
    "error": lambda y, s: _share(V.argmax(s) != y.cast("int")),
    "precision": lambda y, s: _share(V.argmax(s) == y.cast("int")),
    "cross-entropy": lambda y, s: -F.log(F.greatest(_at(V.softmax(s), y), F.lit(V.LARGER_EPSILON))),
}


def s_sq(s: Column) -> Column:
    return F.transform(s, lambda x: x * x)


FAMILIES = {"binary": BINARY, "signed": SIGNED, "multi": MULTI}


def metric(name: str, family: str) -> Metric:
    if name not in FAMILIES[family]:
        raise ValueError(f"no metric {name} for {family} scores")
    return FAMILIES[family][name]


def evaluate(df: DataFrame, names: Sequence[str], family: str, *, label: str = "label", score: str = "score") -> DataFrame:
    """One row with the average of each metric, in one pass; zeros for an empty table."""
    columns = [F.coalesce(F.avg(metric(n, family)(F.col(label), F.col(score))), F.lit(0.0)).alias(n.replace("-", "_")) for n in names]
    return df.agg(*columns)
