"""Gaussian naive Bayes on sparse rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.readers import to_long
from ..sources.storage import materialize
from . import stats
from .params import Supervised, require, rows_of


def log_scores(long: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, log_score): log prior plus the log densities of the entries that are present,
    floored at 1e-8; features of no variance in a class are left out."""
    entry = F.when(F.col("var") >= V.EPSILON, F.greatest(V.log_gaussian(F.col("value"), F.col("mean"), F.col("var")), F.log(F.lit(V.EPSILON)))).otherwise(F.lit(0.0))
    joined = long.join(model, "fid")
    return joined.groupBy(*keys, model["label"]).agg((F.sum(entry) + F.log(F.first("prior"))).alias("log_score"))


def row_log_scores(rows: DataFrame, model: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, scores): log_scores of sparse rows as an array of (label, log_score), a row by itself. The model
    is a constant of the plan: no more than vectors.MAX_LITERAL moments."""
    moments = model.select("label", "fid", "mean", "var", "prior").collect()  # bounded, as above
    if len(moments) > V.MAX_LITERAL:
        raise ValueError(f"{len(moments)} moments are too many for a constant; use log_scores")
    dim, out = 1 + max((m.fid for m in moments), default=-1), []
    for label in sorted({m.label for m in moments}):
        own = {m.fid: m for m in moments if m.label == label}
        mean, var = ([float(getattr(own[f], c)) if f in own else 0.0 for f in range(dim)] for c in ("mean", "var"))
        mean, var = V.literal(mean), V.literal(var)  # a variance of 0 leaves the entry out
        at = lambda t, i: F.get(t, i)
        entry = lambda i, x: F.when(at(var, i) >= V.EPSILON, F.greatest(V.log_gaussian(x, at(mean, i), at(var, i)), F.log(F.lit(V.EPSILON)))).otherwise(F.lit(0.0))
        score = V.total(F.zip_with("indices", "values", entry)) + math.log(next(iter(own.values())).prior)
        out.append(F.struct(F.lit(label).alias("label"), score.alias("log_score")))
    return rows.select(*keep, F.array(*out).alias("scores"))


class NaiveBayes(Supervised):
    name = "NaiveBayes"

    @classmethod
    def defaults(cls) -> dict:
        return {"num_label": 2, "metrics": "cross-entropy"}

    def check(self) -> None:
        require(self["num_label"] >= 2, "num_label must be at least 2")

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> NaiveBayes:
        rows = stats.check_labels(rows_of(train), self["num_label"])
        counts = stats.label_counts(rows)
        long = to_long(rows, ("row_id", "label")).withColumn("label", F.col("label").cast("int"))
        self.model = materialize(stats.class_moments(long, counts), "bayes")
        total = counts.agg(F.sum("n").alias("t"))
        self.priors = materialize(counts.join(F.broadcast(total)).select("label", (F.col("n") / F.col("t")).alias("prior")), "priors")  # one row each class
        self._log(0, valid)
        return self

    def predict_score(self, data: DataFrame) -> DataFrame:
        """Scores are unnormalised: prior times likelihood, always one per class."""
        k = self["num_label"]
        if self.model.count() <= V.MAX_LITERAL:
            found = row_log_scores(data, self.model, ["row_id", "indices"])
            scores = found.where(F.size("indices") > 0).select("row_id", F.explode("scores").alias("s")).select("row_id", "s.label", "s.log_score")
        else:
            scores = log_scores(to_long(data), self.model, ["row_id"])
        wide = scores.groupBy("row_id").agg(*[F.max(F.when(F.col("label") == c, F.col("log_score"))).alias(f"s{c}") for c in range(k)])
        priors = {r.label: r.prior for r in self.priors.collect()}  # one row each class
        filled = [F.exp(F.coalesce(F.col(f"s{c}"), F.log(F.lit(float(priors.get(c, 0.0)))), F.lit(float("-inf")))) for c in range(k)]
        return data.select("row_id").join(wide, "row_id", "left").select("row_id", F.array(*filled).alias("score"))

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {"moments": self.model, "priors": self.priors}

    def restore(self, parts: dict[str, DataFrame]) -> None:
        self.model, self.priors = parts["moments"], parts["priors"]
