"""Vector operations on the long form (key, fid, value), as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str] | None = None) -> DataFrame:
    """Inner products over common fids; keys_b=None: b is one vector (fid, value)."""
    right = b.withColumnRenamed("value", "__v")
    return a.join(right, "fid").groupBy(*keys_a, *(keys_b or [])).agg(F.sum(F.col("value") * F.col("__v")).alias("dot"))


def dot_square(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("value") * F.col("__v")
    return a.join(b.withColumnRenamed("value", "__v"), "fid").groupBy(*keys).agg(F.sum(p * p).alias("dot_square"))


def squared_distance(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distances of vectors that share a key; an absent entry is zero."""
    d = F.coalesce("value", F.lit(0.0)) - F.coalesce("__v", F.lit(0.0))
    return a.join(b.withColumnRenamed("value", "__v"), [key, "fid"], "full").groupBy(key).agg(F.sum(d * d).alias("dist"))


def axpy(y: DataFrame, a: float, x: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """y + a x over all entries of either (dense y has them all)."""
    keys = [*(keys or []), "fid"]
    return y.select(*keys, "value").union(x.select(*keys, (F.lit(a) * F.col("value")).alias("value"))).groupBy(*keys).agg(F.sum("value").alias("value"))


def axpy_within(y: DataFrame, a: float, x: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """y + a x on y's entries only (sparse y keeps its pattern)."""
    keys = [*(keys or []), "fid"]
    return y.join(x.select(*keys, F.col("value").alias("__v")), keys, "left").select(*keys, (F.col("value") + F.lit(a) * F.coalesce("__v", F.lit(0.0))).alias("value"))


def axpy_sparse_dense(y: DataFrame, a: float, x: DataFrame) -> DataFrame:
    """A sparse vector cannot take a dense one: its pattern would change."""
    raise TypeError("a sparse vector cannot take a dense one; add into a dense vector with axpy")


def hadamard(y: DataFrame, x: DataFrame, keys: list[str] | None = None, touched_only: bool = False) -> DataFrame:
    """Entry-wise product; entries of y that x lacks stay, or go with touched_only."""
    keys = [*(keys or []), "fid"]
    return y.join(x.select(*keys, F.col("value").alias("__v")), keys, "inner" if touched_only else "left").select(*keys, (F.col("value") * F.coalesce("__v", F.lit(1.0))).alias("value"))


def lookup(long: DataFrame, wanted: DataFrame, keys: list[str], default: float = -1.0) -> DataFrame:
    """Values at wanted (keys, fid); `default` where there is none."""
    return wanted.join(long, [*keys, "fid"], "left").withColumn("value", F.coalesce("value", F.lit(default)))
