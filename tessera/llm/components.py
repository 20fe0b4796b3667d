"""Connected components of an edge table by alternating large-star and small-star steps.

Tasks first contract the edges they hold to stars around the smallest node. Every step is then an
aggregate and a join on slim rows, in which nodes with more than a thousandth of the edges are
broadcast; no neighbour list is ever gathered, and each round is written to the shared folder, so
lost executors cost one round at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import join_groups, materialize


class Forest:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y] = up.setdefault(y, y)
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches):
    """Edges of a run of batches to stars; memory is bounded by the rows taken at a time."""
    forest, held = Forest(), 0

    def stars():
        pairs = [(x, r) for x in list(forest.up) if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["hi", "lo"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            forest.join(a, b)
        held += batch.num_rows
        if held > 1_000_000:
            yield stars()
            forest, held = Forest(), 0
    if held:
        yield stars()


def _round(e: DataFrame, edges: int) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")
    large = join_groups(both, least, "u", "c", 2 * edges, "inner").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    large = materialize(large, "large-star")
    small = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("c"))
    moved = join_groups(large, small, "hi", "c", edges, "inner").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.union(small.select("hi", "m")).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge of whole numbers with the smallest node of its component.
    Loops, null ends and repeated edges are allowed; an empty table gives an empty result."""
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
    e = materialize(e.mapInArrow(_contract, "hi bigint, lo bigint").distinct(), "stars")
    state = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo").distinct())
        state = now
        e = materialize(_round(e, now[0]), "round")
