"""k nearest neighbours: exact, with both sides in blocks of a bounded size.

Queries and labelled rows are dealt into blocks, and every pair of blocks is a group of a shuffle: nothing goes
through the driver. A group finds candidates with a matrix product, takes their distances exactly, and
keeps the k best of each query; these meet in one window, k rows per query and labelled block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources import persist
from .params import Params, frame_of

BLOCK_BYTES = 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths != lengths[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(lengths), -1)


def best_of_block(points: np.ndarray, rows: np.ndarray, k: int, same: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, squared distance) of each query's k nearest rows, with all ties at the last
    place. same: the ids of queries and rows, of which equal ones are not to be taken. All pairs are seen
    some millions at a time."""
    norms = (rows**2).sum(axis=1)
    m = min(k, len(rows))
    found = []
    step = max(1, (1 << 22) // max(1, len(rows)))
    for lo in range(0, len(points), step):
        part = points[lo : lo + step]
        near = norms[None, :] - 2 * (part @ rows.T) + (part**2).sum(axis=1)[:, None]
        if same is not None:
            near[same[0][lo : lo + step, None] == same[1][None, :]] = np.inf
        slack = 1e-9 * (norms.max(initial=0.0) + (part**2).sum(axis=1)) + 1e-12  # far beyond the product's rounding
        q, r = np.nonzero(near <= (np.partition(near, m - 1, axis=1)[:, m - 1] + slack)[:, None])
        good = np.isfinite(near[q, r])
        q, r = q[good], r[good]
        dist = np.zeros(len(q))
        for j in range(rows.shape[1]):
            dist += (part[q, j] - rows[r, j]) ** 2
        order = np.lexsort((dist, q))
        q, r, dist = q[order], r[order], dist[order]
        first = np.searchsorted(q, q)
        last = np.minimum(first + m, np.searchsorted(q, q, side="right")) - 1
        keep = dist <= dist[last]
        found.append((lo + q[keep], r[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def block_groups(batches) -> Iterator[tuple[pa.Table, pa.Table]]:
    """(labelled rows, queries) of each pair of blocks, from rows sorted by i, j and side."""
    key, held = None, []

    def sides():
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = int(np.searchsorted(rows.column("side").to_numpy(), 1))
        return rows.slice(0, cut).combine_chunks(), rows.slice(cut).combine_chunks()

    for batch in batches:
        keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else []
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            if tuple(keys[lo]) != key:
                if held:
                    yield sides()
                key, held = tuple(keys[lo]), []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield sides()


def _search(k: int, skip_self: bool):
    def run(batches):
        for rows, asked in block_groups(batches):
            if rows.num_rows and asked.num_rows:
                part = lambda t, name: t.column(name).chunk(0)
                ids, keys = part(rows, "id").to_numpy(), part(asked, "id").to_numpy()
                same = (keys, ids) if skip_self else None
                q, r, dist = best_of_block(_matrix(part(asked, "f")), _matrix(part(rows, "f")), k, same)
                yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(ids[r]), part(rows, "label").take(pa.array(r)), pa.array(dist)], ["query", "neighbour", "label", "dist"])

    return run


def nearest(queries: DataFrame, labelled: DataFrame, k: int, *, query_id: str = "row_id", row_id: str = "row_id", features: str = "features", label: str = "label", skip_self: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query, neighbour, label, dist, rank): the k labelled rows of least squared distance, the
    smaller id first on ties."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, dim = labelled.agg(F.count("*"), F.coalesce(F.max(F.size(features)), F.lit(1))).first()
    if n <= k:
        raise ValueError("there must be more labelled rows than neighbours")
    asked = queries.count()
    held = max(1, block_bytes // (8 * max(1, dim)))  # rows of a block
    cuts = -(-n // held)
    # enough groups for all cores, with few copies of both sides: neither is cut much finer than the other
    groups = max(1, min(parts, -(-asked // 256)))
    cuts = max(cuts, min(int(groups**0.5), -(-n // 256)))
    turns = max(-(-asked // held), -(-groups // cuts), 1)
    until = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = labelled.select(F.col(row_id).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"), F.col(features).alias("f"))
    rows = rows.select(until(turns).alias("i"), place("id", cuts).alias("j"), F.lit(0).alias("side"), "id", "label", "f")
    points = queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(features).alias("f"))
    points = points.select(place("id", turns).alias("i"), until(cuts).alias("j"), F.lit(1).alias("side"), "id", F.lit(None).cast("int").alias("label"), "f")
    groups = rows.union(points).repartition(max(parts, turns * cuts), "i", "j").sortWithinPartitions("i", "j", "side")
    found = groups.mapInArrow(_search(k, skip_self), "query bigint, neighbour bigint, label int, dist double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("dist", "neighbour")))
    return ranked.where(F.col("rank") <= k)


def vote(neighbours: DataFrame, num_label: int) -> DataFrame:
    """(query, score array): votes over the number of classes, through a soft-max."""
    counts = [F.count(F.when(F.col("label") == c, 1)) / num_label for c in range(num_label)]
    return neighbours.groupBy("query").agg(F.array(*counts).alias("raw")).select("query", V.softmax("raw").alias("score"))


def dense(rows: DataFrame) -> DataFrame:
    """Sparse rows as dense ones of equal length; an absent entry is zero."""
    if "features" in rows.columns:
        return rows
    last = rows.agg(F.max(F.array_max("indices"))).first()[0]
    dim = 1 if last is None else last + 1
    m = F.map_from_arrays("indices", "values")
    return rows.withColumn("__m", m).withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at(F.col("__m"), i), F.lit(0.0)))).drop("__m")


class KNN:
    """Lazy learner: labelled rows come with every call."""

    def __init__(self, num_label: int, num_neighbor: int = 5):
        if num_label < 2 or num_neighbor < 1:
            raise ValueError("two labels and one neighbour are the least")
        self.params = Params(num_label=num_label, num_neighbor=num_neighbor)

    name = "KNN"

    def predict_score(self, labeled: DataFrame, data: DataFrame) -> DataFrame:
        both = frame_of(labeled).withColumn("__side", F.lit(1)).unionByName(frame_of(data).withColumn("__side", F.lit(0)), allowMissingColumns=True)
        both = dense(both)
        labeled, data = (both.where(F.col("__side") == k).drop("__side") for k in (1, 0))
        return vote(nearest(data, labeled, self.params["num_neighbor"]), self.params["num_label"])

    def predict_proba(self, labeled: DataFrame, data: DataFrame) -> DataFrame:
        """The scores through a second soft-max."""
        return self.predict_score(labeled, data).select("query", V.softmax("score").alias("proba"))

    def save_model(self, spark, path: str) -> None:
        """There is nothing but the parameters: labelled rows come with every call."""
        persist.save(spark, path, self.name, dict(self.params), {})

    @classmethod
    def load_model(cls, spark, path: str) -> KNN:
        params, _ = persist.load(spark, path, cls.name)
        return cls(**params)

    def evaluate(self, labeled: DataFrame, data: DataFrame, metrics: list[str]) -> DataFrame:
        from ..functions.metrics import evaluate

        data = frame_of(data)
        scored = self.predict_score(labeled, data).join(data.select(F.col("row_id").alias("query"), "label"), "query")
        return evaluate(scored, metrics, "multi")
