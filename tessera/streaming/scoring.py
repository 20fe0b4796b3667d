"""Streams: scoring with a fitted model, windowed sums with late data, and online updates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import losses, vectors as V


def score_stream(stream: DataFrame, weights: list[float], bias: float, features: list[Column]) -> DataFrame:
    """Stateless scoring: works on streams and tables alike."""
    return stream.withColumn("score", V.dot(F.array(*features), V.literal(weights)) + float(bias))


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; rows later than the watermark are left out."""
    if stream.isStreaming:
        stream = stream.withWatermark(time, late)
    return stream.groupBy(F.window(time, width, slide) if slide else F.window(time, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


class OnlineLinear:
    """A linear model that a stream of batches updates: pass `update` to foreachBatch."""

    def __init__(self, dim: int, loss: str = "square", learning_rate: float = 0.1):
        self.weights, self.bias, self.loss, self.rate = np.zeros(dim), 0.0, losses.loss(loss), learning_rate

    def update(self, batch: DataFrame, batch_id: int = 0) -> None:
        """batch (features array<double>, label)."""
        scored = batch.withColumn("score", V.dot("features", V.literal(self.weights)) + float(self.bias))
        g = self.loss.grad(F.col("label"), F.col("score"))
        sums = [F.sum(g * F.get("features", F.lit(i))) for i in range(len(self.weights))]
        n, bias, *grads = scored.agg(F.count("*"), F.sum(g), *sums).first()
        if n:
            self.weights = self.weights - self.rate / n * np.array(grads, float)
            self.bias -= self.rate / n * bias
