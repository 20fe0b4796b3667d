"""MLlib learners as a cross-check: close in quality, never equal."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression as MLlibLogistic
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from tessera.operators import factorization, linear
from tessera.sources import readers


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        x = rng.normal(size=3)
        rows.append((i, 1.0 if x @ [1.5, -2, 0.5] + rng.normal() / 2 > 0 else -1.0, [float(v) for v in x]))
    return spark.createDataFrame(rows, "row_id bigint, label double, features array<double>")


def test_logistic_regression(data):
    rows = readers.from_dense(data)
    model = linear.LogisticRegression(num_epoch=5, batch_size=150, learning_rate=1.0).fit(rows)
    own = model.evaluate(rows, ["precision"]).first()[0]
    v = data.select(((F.col("label") + 1) / 2).alias("label"), array_to_vector("features").alias("features"))
    fitted = MLlibLogistic().fit(v).transform(v)
    theirs = fitted.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert abs(own - theirs) < 0.06


def test_factorisation(spark):
    rng = np.random.default_rng(2)
    p, q = rng.random((25, 2)), rng.random((20, 2))
    ratings = spark.createDataFrame([(u, v, float(1 + 4 * p[u] @ q[v])) for u in range(25) for v in range(20)], "u int, v int, r double")
    own = factorization.evaluate(factorization.NMF(embedding_dim=3, num_epoch=4).fit(ratings).predict(ratings), ["rmse"]).first().rmse
    fitted = ALS(rank=3, maxIter=10, regParam=0.01, userCol="u", itemCol="v", ratingCol="r", seed=1).fit(ratings).transform(ratings)
    theirs = fitted.agg(F.sqrt(F.avg(F.pow(F.col("r") - F.col("prediction"), 2)))).first()[0]
    spread = float(np.std([r.r for r in ratings.collect()]))
    assert own < 0.5 * spread and theirs < 0.5 * spread
