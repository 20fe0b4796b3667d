"""Models on disk: parameters as JSON text, and one Parquet table per part of the model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(spark: SparkSession, path: str, name: str, params: dict, parts: dict[str, DataFrame]) -> None:
    head = json.dumps({"model": name, "params": params, "parts": sorted(parts)})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/head")
    for part, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str, name: str) -> tuple[dict, dict[str, DataFrame]]:
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    if head["model"] != name:
        raise ValueError(f"{path} holds a {head['model']}, not a {name}")
    return head["params"], {p: spark.read.parquet(f"{path}/{p}") for p in head["parts"]}
