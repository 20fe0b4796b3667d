"""Distributed vectors and matrices with push, pull, dot and axpy.

A state is a table (idx, value) or (col, array); pushes are summed before they are added, so every
superstep is one aggregate, and a superstep's action is its barrier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import materialize


class DistributedVector:
    def __init__(self, table: DataFrame, length: int):
        self.table, self.length = table, length

    @classmethod
    def zeros(cls, spark: SparkSession, length: int) -> DistributedVector:
        return cls(spark.range(length).select(F.col("id").alias("idx"), F.lit(0.0).alias("value")), length)

    def derive(self) -> DistributedVector:
        """A new vector of zeros with the same layout."""
        return DistributedVector(self.table.select("idx", F.lit(0.0).alias("value")), self.length)

    def push(self, *updates: DataFrame) -> DistributedVector:
        """Add (idx, value) tables; indices outside the vector are ignored."""
        if not updates:
            return self
        sums = reduce(DataFrame.unionByName, [u.select("idx", "value") for u in updates]).groupBy("idx").agg(F.sum("value").alias("__add"))
        table = self.table.join(sums, "idx", "left").select("idx", (F.col("value") + F.coalesce("__add", F.lit(0.0))).alias("value"))
        return DistributedVector(table, self.length)

    def pull(self, offsets: DataFrame | None = None) -> DataFrame:
        """All entries, or those at the given (idx)."""
        return self.table if offsets is None else offsets.select("idx").join(self.table, "idx")

    def push_pull(self, *updates: DataFrame) -> DataFrame:
        return self.push(*updates).pull()

    def dot(self, other: DistributedVector) -> DataFrame:
        return self.table.join(other.table.withColumnRenamed("value", "__v"), "idx").agg(F.coalesce(F.sum(F.col("value") * F.col("__v")), F.lit(0.0)).alias("dot"))

    def axpy(self, a: float, x: DistributedVector, b: float = 0.0) -> DistributedVector:
        """self + a x + b."""
        joined = self.table.join(x.table.withColumnRenamed("value", "__v"), "idx")
        return DistributedVector(joined.select("idx", (F.col("value") + F.lit(a) * F.col("__v") + F.lit(b)).alias("value")), self.length)

    def add_to(self, x: DistributedVector) -> DistributedVector:
        return self.axpy(1.0, x)

    def minus(self, x: DistributedVector) -> DistributedVector:
        return self.axpy(-1.0, x)

    def norm2(self) -> DataFrame:
        return self.table.agg(F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0))).alias("norm2"))

    def nnz(self) -> DataFrame:
        return self.table.agg(F.count(F.when(F.col("value") != 0, 1)).alias("nnz"))

    def partitioned(self, servers: int) -> DataFrame:
        """Entries with the server that holds them: equal ranges, the rest on the last."""
        width = max(1, self.length // servers)
        return self.table.withColumn("server", F.least((F.col("idx") / width).cast("bigint"), F.lit(servers - 1)))

    def barrier(self) -> DistributedVector:
        return DistributedVector(materialize(self.table, "vector"), self.length)


class DistributedMatrix:
    """Columns (col, values array<double>), pushed and pulled by column."""

    def __init__(self, table: DataFrame, rows: int):
        self.table, self.rows = table, rows

    @classmethod
    def zeros(cls, spark: SparkSession, rows: int, cols: int) -> DistributedMatrix:
        return cls(spark.range(cols).select(F.col("id").alias("col"), F.array_repeat(F.lit(0.0), rows).alias("values")), rows)

    def push_cols(self, updates: DataFrame) -> DistributedMatrix:
        sums = F.array(*[F.sum(F.get("values", F.lit(i))) for i in range(self.rows)])
        added = updates.groupBy("col").agg(sums.alias("__add"))
        table = self.table.join(added, "col", "left").select("col", F.when(F.col("__add").isNull(), F.col("values")).otherwise(F.zip_with("values", "__add", lambda x, y: x + y)).alias("values"))
        return DistributedMatrix(table, self.rows)

    def pull_cols(self, cols: DataFrame | None = None) -> DataFrame:
        return self.table if cols is None else cols.select("col").join(self.table, "col")


def merge_store(store: DataFrame, pushes: DataFrame) -> DataFrame:
    """Key-value store (key, value): a push adds to its key."""
    return store.select("key", "value").unionByName(pushes.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))
