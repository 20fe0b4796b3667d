"""The shared folder of the cluster, and cutting lineage through it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, a temporary root is set, but only
    in a session of one process: executors of a cluster share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: For rows of megabytes: a reader holds a row group of them with an entry and its levels for each element, and
#: the writer looks at its size after every row, not after a hundred.
LARGE_ROWS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.row.count.limit": "4"}


def materialize(df: DataFrame, name: str, by: list[str] | None = None, large: bool = False) -> DataFrame:
    """Cut lineage: write to the shared folder and read back (survives lost executors). by: columns
    whose values get folders of their own, so that a filter on them reads no other. large: rows of megabytes."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.options(**LARGE_ROWS) if large else df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Turns:
    """Tables of a loop, in a folder of their own for each turn: what a turn has written is read by it and the next one,
    and is removed after that, so that disk does not grow with the number of turns."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.turn = spark, 0
        self.path = shared_dir(spark, name)

    def keep(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """As `materialize`."""
        path = f"{self.path}/{self.turn}/{name}-{uuid.uuid4().hex}"
        (df.write.options(**LARGE_ROWS) if large else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def next(self) -> None:
        """Begin a turn, when nothing reads what was written before the last one."""
        if self.turn:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{self.turn - 1}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        self.turn += 1


class Routed:
    """A table to which rows are sent for later turns: appended to the shared folder, by turn (`turn`) and in buckets
    of a key, so that a turn's rows are read alone and groups of the key need no shuffle."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path, self.table = shared_dir(spark, name), f"{name}_{uuid.uuid4().hex}"

    def send(self, df: DataFrame) -> None:
        df.write.mode("append").partitionBy("turn").bucketBy(self.buckets, self.key).option("path", self.path).saveAsTable(self.table)
        self.schema = self.spark.table(self.table).schema

    def at(self, turn: int) -> DataFrame:
        return self.spark.table(self.table).where(f"turn = {turn}")

    def since(self, turn: int) -> DataFrame:
        """What has been sent so far for a turn and later ones."""
        return self.spark.read.schema(self.schema).parquet(self.path).where(f"turn >= {turn}")

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"drop table if exists {self.table}")
