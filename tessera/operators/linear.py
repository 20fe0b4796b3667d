"""Mini-batch gradient learners: logistic regression, support vector machine, linear regression and
factorisation machine.

A batch is scored with the weights at its start and applied once, so a step is one aggregate over
the batch: gradients are summed per feature with partial sums in every task. Batches are of
`batch_size` rows in the order of row_id; they are written once, in sorted ranges with a folder each, of
which a step reads those with its rows. Weights are a folded constant up to
vectors.MAX_LITERAL entries; longer ones are a table that the batch's entries are joined with.

A linear regression's step needs no more of a batch than its moments, which one aggregate takes of all
batches at once; where a prediction might be cut off, the batch itself is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import losses, vectors as V
from ..sources.readers import ranges, start_of
from ..sources.storage import materialize
from . import stats
from .params import Supervised, require, rows_of

_SGD = {"num_epoch": 10, "batch_size": 1000, "learning_rate": 0.1, "l1_reg": 0.0, "l2_reg": 0.0}


def scores(rows: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """rows with `score`: inner product and bias."""
    if len(weights) <= V.MAX_LITERAL:
        return rows.withColumn("score", V.sparse_dot("indices", "values", V.literal(weights)) + float(bias))
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights) if w], "fid int, w double")
    entries = rows.select("row_id", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    sums = entries.join(table, F.col("e.indices") == F.col("fid")).groupBy("row_id").agg(F.sum(F.col("e.values") * F.col("w")).alias("__s"))
    return rows.join(sums, "row_id", "left").withColumn("score", F.coalesce("__s", F.lit(0.0)) + float(bias)).drop("__s")


def batch_gradient(scored: DataFrame, grad: Column, by: list[str] | None = None, loss: Column | None = None) -> DataFrame:
    """(by, fid, g): sums of grad times value; fid -1 has the bias, -2 the row count and, with a loss,
    -3 its sum, all from one pass."""
    g = scored.withColumn("__g", grad)
    more = [(-1, F.col("__g")), (-2, F.lit(1.0)), *([(-3, loss)] if loss is not None else [])]
    own = F.array(*[F.struct(F.lit(k).alias("fid"), c.cast("double").alias("g")) for k, c in more])
    entries = F.concat(own, F.zip_with("indices", "values", lambda i, x: F.struct(i.alias("fid"), (x * F.col("__g")).alias("g"))))
    return g.select(*(by or []), F.explode(entries).alias("e")).groupBy(*(by or []), "e.fid").agg(F.sum("e.g").alias("g"))


#: Features up to which the moments of batches are taken.
MOMENT_DIM = 64


def batch_moments(rows: DataFrame, dim: int) -> DataFrame:
    """(batch, m, top) by batch: the matrix of the sums of products of the features, one and the label, row by row,
    and the features' and the one's largest sizes. Each Arrow batch gives the sums of its own rows."""
    side = dim + 2

    def run(batches):
        for batch in batches:
            number, label, indices, values = (batch.column(i) for i in range(4))
            if not batch.num_rows:
                continue
            sizes = np.nan_to_num(indices.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            x = np.zeros((batch.num_rows, side))
            np.add.at(x, (np.repeat(np.arange(len(x)), sizes), indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)), values.flatten().to_numpy(zero_copy_only=False))
            x[:, dim], x[:, dim + 1] = 1.0, label.to_numpy(zero_copy_only=False)
            kinds, at = np.unique(number.to_numpy(), return_inverse=True)
            own = [x[at == k] for k in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array([(a.T @ a).ravel().tolist() for a in own]), pa.array([np.abs(a[:, :-1]).max(axis=0).tolist() for a in own])], ["batch", "m", "top"])

    found = rows.select("batch", "label", "indices", "values").mapInArrow(run, "batch bigint, m array<double>, top array<double>")
    m = F.array(*[F.sum(F.get("m", F.lit(i))) for i in range(side * side)])
    top = F.array(*[F.max(F.get("top", F.lit(i))) for i in range(dim + 1)])
    return materialize(found.groupBy("batch").agg(m.alias("m"), top.alias("top")), "moments").orderBy("batch")


class LinearModel(Supervised):
    loss_name = "logistic"
    signed = True

    @classmethod
    def defaults(cls) -> dict:
        return {**_SGD, "loss": cls.loss_name, "metrics": cls.metric_name, "seed": 0}

    metric_name = "log-loss"

    def check(self) -> None:
        require(self["num_epoch"] > 0 and self["batch_size"] > 0, "num_epoch and batch_size must be positive")
        require(self["learning_rate"] > 0 and self["l1_reg"] >= 0 and self["l2_reg"] >= 0, "rates must not be negative")
        losses.loss(self["loss"])

    def start(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self["seed"]).normal(0, V.xavier_scale(dim), dim)

    def prepare(self, train: DataFrame) -> tuple[DataFrame, int, int]:
        """Rows with their batch, written once; batches; features."""
        rows = rows_of(train) if self.regression else stats.check_labels(rows_of(train))
        size, n = self["batch_size"], train.count()
        if size >= n:
            self._starts = None
            rows = materialize(rows.withColumn("batch", F.lit(0).cast("bigint")), "batches")
        else:
            rows, self._starts = ranges(rows, "row_id", n, folders=True)
            rows = rows.withColumn("batch", F.floor((start_of(self._starts) + F.col("__i")) / size))
        return rows, -(-n // size), stats.max_dim(rows)

    def batch(self, rows: DataFrame, b: int) -> DataFrame:
        if self._starts is None:
            return rows
        lo, hi, starts = b * self["batch_size"], (b + 1) * self["batch_size"], self._starts
        held = [p for p in range(len(starts) - 1) if starts[p] < hi and starts[p + 1] > lo]
        if len(held) == 1:  # pages of the range's file
            rows = rows.where(F.col("__i").between(lo - starts[held[0]], hi - 1 - starts[held[0]]))
        return rows.where(F.col("__p").isin(held) & (F.col("batch") == b))

    def batches(self, rows: DataFrame, n: int):
        for b in range(n):
            yield self.batch(rows, b)

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> LinearModel:
        rows, n, dim = self.prepare(train)
        self.weights, self.bias = self.start(dim), 0.0
        for epoch in range(self["num_epoch"]):
            losses_seen = list(self.epoch(rows, n))
            self.history.append((epoch, "train", "loss", float(np.mean(losses_seen)) if losses_seen else 0.0))
            self._log(epoch, valid)
        return self

    def epoch(self, rows: DataFrame, n: int) -> Iterator[float]:
        """The steps of an epoch; gives each batch's mean loss."""
        return (self.step(batch) for batch in self.batches(rows, n))

    def step(self, batch: DataFrame) -> float:
        loss, y, s = losses.loss(self["loss"]), F.col("label"), F.col("score")
        scored = scores(batch, self.weights, self.bias)
        found = {r.fid: r.g for r in batch_gradient(scored, loss.grad(y, s), loss=loss.value(y, s)).collect()}
        n, total, bias = found.pop(-2, 1.0), found.pop(-3, 0.0), found.pop(-1, 0.0)
        fids = np.array(list(found), int)
        gradient = np.zeros(len(self.weights))
        gradient[fids] = list(found.values())
        self.update(gradient, bias, n)
        return total / n

    def update(self, gradient: np.ndarray, bias: float, n: float) -> None:
        """A step, by the sums over n rows."""
        rate = self["learning_rate"]
        self.weights -= rate / n * gradient
        if self["l2_reg"]:
            self.weights -= rate * self["l2_reg"] * self.weights
        if self["l1_reg"]:
            self.weights = np.sign(self.weights) * np.maximum(np.abs(self.weights) - rate * self["l1_reg"], 0)
        self.bias -= rate / n * bias

    def predict_score(self, data: DataFrame) -> DataFrame:
        return scores(data, self.weights, self.bias).select("row_id", "score")

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(-1, float(self.bias)), *((i, float(w)) for i, w in enumerate(self.weights))]
        return {"weights": spark.createDataFrame(rows, "fid int, w double")}

    def restore(self, parts: dict[str, DataFrame]) -> None:
        found = {r.fid: r.w for r in parts["weights"].collect()}
        self.bias = found.pop(-1)
        self.weights = np.array([found[i] for i in range(len(found))])


class LogisticRegression(LinearModel):
    name = "LogisticRegression"


class SupportVectorMachine(LinearModel):
    name, loss_name, metric_name = "SupportVectorMachine", "hinge", "hinge-loss"


class LinearRegression(LinearModel):
    """Starts from zero weights, so a fit is reproducible step by step."""

    name, loss_name, metric_name = "LinearRegression", "square", "mse"
    regression = True

    def start(self, dim: int) -> np.ndarray:
        return np.zeros(dim)

    def epoch(self, rows: DataFrame, n: int) -> Iterator[float]:
        dim = len(self.weights)
        if n < 2 or self["loss"] != "square" or dim > MOMENT_DIM or self["batch_size"] < 4 * (dim + 2) ** 2:
            return super().epoch(rows, n)
        return self._by_moments(rows, dim)

    def _by_moments(self, rows: DataFrame, dim: int) -> Iterator[float]:
        for r in batch_moments(rows, dim).toLocalIterator():  # one row a batch, by batch
            m, top = np.array(r.m).reshape(dim + 2, dim + 2), np.array(r.top)
            w = np.append(self.weights, self.bias)
            if not np.abs(w) @ top < 20:  # some prediction may be cut off
                yield self.step(self.batch(rows, r.batch))
                continue
            xx, xy, count = m[:-1, :-1], m[:-1, -1], m[-2, -2]
            gradient = xx @ w - xy
            yield float(0.5 * (w @ xx @ w - 2 * w @ xy + m[-1, -1]) / count)
            self.update(gradient[:-1], gradient[-1], count)


def _square_with(v: Column):
    return lambda i, x: F.pow(x * F.coalesce(F.get(v, i), F.lit(0.0)), 2)


def fm_score(indices: str, values: str, w: Column, factors: list[Column]) -> Column:
    """w x + half the sum over factors of (v x)^2 - sum (v_j x_j)^2; no intercept."""
    out = V.sparse_dot(indices, values, w)
    for v in factors:
        inner = V.sparse_dot(indices, values, v)
        out = out + 0.5 * (inner * inner - V.total(F.zip_with(F.col(indices), F.col(values), _square_with(v))))
    return out


class FactorizationMachine(LinearModel):
    name = "FactorizationMachine"

    @classmethod
    def defaults(cls) -> dict:
        return {**super().defaults(), "embedding_dim": 16}

    def check(self) -> None:
        super().check()
        require(self["embedding_dim"] > 0, "embedding_dim must be positive")

    def start(self, dim: int) -> np.ndarray:
        """A row of weights, then one for each factor."""
        return np.random.default_rng(self["seed"]).normal(0, V.xavier_scale(dim), (self["embedding_dim"] + 1, dim))

    def _scored(self, rows: DataFrame) -> DataFrame:
        """rows with `score` and `__inner`, the inner product with each factor."""
        if self.weights.shape[1] > V.MAX_LITERAL:
            return self._scored_by_join(rows)
        inner = F.array(*[V.sparse_dot("indices", "values", V.literal(v)) for v in self.weights[1:]])
        square = V.literal((self.weights[1:] ** 2).sum(axis=0))
        own = V.total(F.zip_with("indices", "values", lambda i, x: x * x * F.coalesce(F.get(square, i), F.lit(0.0))))
        rows = rows.withColumn("__inner", inner)
        return rows.withColumn("score", V.sparse_dot("indices", "values", V.literal(self.weights[0])) + 0.5 * (V.dot("__inner", "__inner") - own))

    def _scored_by_join(self, rows: DataFrame) -> DataFrame:
        k = self["embedding_dim"]
        table = self.parts(rows.sparkSession)["weights"]
        entries = rows.select("row_id", F.explode(F.arrays_zip("indices", "values")).alias("e")).select("row_id", F.col("e.indices").alias("fid"), F.col("e.values").alias("x"))
        x, v = F.col("x"), lambda f: F.coalesce(F.get("v", F.lit(f)), F.lit(0.0))
        sums = entries.join(table, "fid").groupBy("row_id").agg(F.sum(x * F.col("w")).alias("__w"), F.sum(x * x * V.dot("v", "v")).alias("__own"), F.array(*[F.sum(x * v(f)) for f in range(k)]).alias("__inner"))
        out = rows.join(sums, "row_id", "left").withColumn("__inner", F.coalesce("__inner", F.array_repeat(F.lit(0.0), k)))
        score = F.coalesce("__w", F.lit(0.0)) + 0.5 * (V.dot("__inner", "__inner") - F.coalesce("__own", F.lit(0.0)))
        return out.withColumn("score", score).drop("__w", "__own")

    def step(self, batch: DataFrame) -> float:
        loss, y, s = losses.loss(self["loss"]), F.col("label"), F.col("score")
        k, rate = self["embedding_dim"], self["learning_rate"]
        scored = self._scored(batch).withColumn("__g", loss.grad(y, s)).withColumn("__l", loss.value(y, s))
        # d score / d v_jf = x_j <v_f, x> - x_j^2 v_jf: both sums per feature, v is the batch's start
        entries = scored.select("__g", "__inner", F.explode(F.arrays_zip("indices", "values")).alias("e"))
        gx = F.col("__g") * F.col("e.values")
        sums = entries.groupBy(F.col("e.indices").alias("fid")).agg(F.array(F.sum(gx), F.sum(gx * F.col("e.values")), *[F.sum(gx * F.get("__inner", F.lit(f))) for f in range(k)]).alias("g"))
        total, n = scored.agg(F.sum("__l"), F.count("*")).first()
        change = np.zeros_like(self.weights)
        for row in sums.collect():  # one row per feature of the model
            first, second, *inner = row.g
            change[0, row.fid] = first
            change[1:, row.fid] = np.array(inner) - second * self.weights[1:, row.fid]
        self.weights -= rate / n * change
        return total / n

    def predict_score(self, data: DataFrame) -> DataFrame:
        return self._scored(data).select("row_id", "score")

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(i, float(c[0]), [float(x) for x in c[1:]]) for i, c in enumerate(self.weights.T)]
        return {"weights": spark.createDataFrame(rows, "fid int, w double, v array<double>")}

    def restore(self, parts: dict[str, DataFrame]) -> None:
        rows = sorted(parts["weights"].collect())
        self.weights, self.bias = np.array([[r.w, *r.v] for r in rows]).T, 0.0
