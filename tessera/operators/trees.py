"""Gradient boosted trees and the boosted random forest, level by level.

Rows are binned once, to sparse pairs of feature and bin that leave out each feature's default bin.
A round writes the rows once, with their predictions and derivatives. A level of a tree is one
aggregate over the rows of the smaller child of each split: sums per (node, feature, bin), kept as a
table, from which the sibling's come by subtraction and the default bins' from the nodes' totals.
Prefix sums over the bins give all split gains. Where a row is in the tree is computed from the splits,
never written. The driver holds splits and leaves only.

Scores come from a table of all nodes that is walked level by level in Arrow batches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import losses, metrics as M, vectors as V
from ..sources.readers import to_long
from ..sources.storage import materialize
from . import stats
from .params import Supervised, require, rows_of


def node_gain(g: Column, h: Column, reg_lambda: float = 0.0, reg_alpha: float = 0.0, max_leaf_weight: float = 0.0) -> Column:
    t = V.soft_threshold(g, reg_alpha) if reg_alpha else g
    if not max_leaf_weight:
        return t * t / (h + reg_lambda)
    w = leaf_weight(g, h, reg_lambda, reg_alpha, max_leaf_weight)
    value = g * w + 0.5 * (h + reg_lambda) * w * w
    return -2.0 * (value + reg_alpha * F.abs(w) if reg_alpha else value)


def leaf_weight(g: Column, h: Column, reg_lambda: float = 0.0, reg_alpha: float = 0.0, max_leaf_weight: float = 0.0, min_child_weight: float = 0.0) -> Column:
    t = V.soft_threshold(g, reg_alpha) if reg_alpha else g
    w = -t / (h + reg_lambda)
    if max_leaf_weight:
        w = V.clip(w, -max_leaf_weight, max_leaf_weight)
    return F.when(h > min_child_weight, w).otherwise(F.lit(0.0))


def histogram(binned: DataFrame, by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """binned (node, fid, bin, g, h, or others that are named) to sums per node, feature and bin."""
    return binned.groupBy(*(["node"] if by is None else by), "fid", "bin").agg(*[F.sum(x).alias(x) for x in names or ["g", "h"]])


def fill_default(hist: DataFrame, totals: DataFrame, splits: DataFrame) -> DataFrame:
    """Add to each feature's default bin what a node's total has beyond the observed entries."""
    seen = hist.groupBy("node", "fid").agg(F.sum("g").alias("sg"), F.sum("h").alias("sh"))
    rest = seen.join(totals.select("node", F.col("g").alias("tg"), F.col("h").alias("th")), "node").join(splits.select("fid", F.col("default_bin").alias("bin")), "fid")
    rest = rest.select("node", "fid", "bin", (F.col("tg") - F.col("sg")).alias("g"), (F.col("th") - F.col("sh")).alias("h"))
    return hist.select("node", "fid", "bin", "g", "h").union(rest).groupBy("node", "fid", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram."""
    keys = ["fid", "bin"]
    minus = child.select(*keys, (-F.col("g")).alias("g"), (-F.col("h")).alias("h"))
    return parent.select(*keys, "g", "h").union(minus).groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def split_gains(hist: DataFrame, *, reg_lambda: float = 0.0, reg_alpha: float = 0.0, max_leaf_weight: float = 0.0, min_child_weight: float = 0.0) -> DataFrame:
    """(node, fid, bin, gain) of all splits `bin or less goes left`, the last bin excluded."""
    run = Window.partitionBy("node", "fid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "fid")
    h = hist.withColumn("gl", F.sum("g").over(run)).withColumn("hl", F.sum("h").over(run)).withColumn("gt", F.sum("g").over(whole)).withColumn("ht", F.sum("h").over(whole)).withColumn("last", F.max("bin").over(whole))
    h = h.where(F.col("bin") < F.col("last")).withColumn("gr", F.col("gt") - F.col("gl")).withColumn("hr", F.col("ht") - F.col("hl"))
    h = h.where((F.col("hl") > min_child_weight) & (F.col("hr") > min_child_weight))
    gain = [node_gain(F.col(f"g{s}"), F.col(f"h{s}"), reg_lambda, reg_alpha, max_leaf_weight) for s in "lrt"]
    return h.select("node", "fid", "bin", (gain[0] + gain[1] - gain[2] - reg_lambda).alias("gain"))


def best_splits(gains: DataFrame, by: list[str], min_gain: float = 0.0) -> DataFrame:
    """The largest gain per `by`, first feature and bin on ties, if it is more than min_gain."""
    ranked = gains.where(F.col("gain") > min_gain).withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gain"), "fid", "bin")))
    return ranked.where("k = 1").drop("k")


def prefix_sums(hist: DataFrame, names: list[str]) -> DataFrame:
    """For every split `bin or less goes left`, the last bin excluded: the sums left (l_) and right (r_) of it,
    and of the node (t_). hist: node, fid, bin and the named sums."""
    run = Window.partitionBy("node", "fid").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "fid")
    out = hist.withColumns({f"l_{x}": F.sum(x).over(run) for x in names} | {f"t_{x}": F.sum(x).over(whole) for x in names} | {"last": F.max("bin").over(whole)})
    out = out.where(F.col("bin") < F.col("last")).withColumns({f"r_{x}": F.col(f"t_{x}") - F.col(f"l_{x}") for x in names})
    return out.drop("last", *names)


def packed_gain(grad: np.ndarray, hess: np.ndarray, reg_lambda: float) -> np.ndarray:
    """Mean over the classes of g' (H + lambda I)^-1 g, of many nodes at once: rows of gradients, and of the
    lower triangles of their second derivatives. NaN where a matrix is not positive definite."""
    return (grad * V.solve_packed(hess, grad, reg_lambda)).sum(axis=1) / max(1, grad.shape[1])


def full_gains(sums: DataFrame, k: int, reg_lambda: float = 0.0) -> DataFrame:
    """`gain` of each row of prefix_sums over g0.. and the packed h0.. of k classes, by a Cholesky factor for each
    side of every split; splits without a factor are left out."""
    grads, hessians = [f"g{c}" for c in range(k)], [f"h{c}" for c in range(k * (k + 1) // 2)]

    def run(batches):
        for batch in batches:
            column = lambda side, names: np.stack([batch.column(f"{side}_{x}").to_numpy(zero_copy_only=False) for x in names], axis=1)
            left, right, whole = (packed_gain(column(s, grads), column(s, hessians), reg_lambda) for s in "lrt")
            gain = left + right - whole - reg_lambda
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gain)], [*batch.schema.names, "gain"]).filter(pa.array(~np.isnan(gain)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema)
    return sums.mapInArrow(run, f"{schema}, gain double")


def goes_right(value: Column, threshold: Column | float) -> Column:
    """1 where a row goes right; an absent value (null or NaN) goes where zero goes."""
    return (F.when(value.isNull() | F.isnan(value), F.lit(0.0)).otherwise(value) >= threshold).cast("int")


#: Splits up to which a tree is walked by conditions.
FEW_NODES = 31


@dataclass
class Tree:
    """nodes: id to (fid, threshold, bin, gain); leaves: id to weights; defaults: a split's default bin, while
    the tree is fitted."""

    nodes: dict[int, tuple[int, float, int, float]] = field(default_factory=dict)
    leaves: dict[int, list[float]] = field(default_factory=dict)
    defaults: dict[int, int] = field(default_factory=dict)

    def value(self, get, k: int, node: int = 0) -> Column:
        """k-th weight of the leaf that a row reaches, as nested conditions; get(fid) is its value."""
        if node in self.nodes:
            fid, threshold, _, _ = self.nodes[node]
            return F.when(goes_right(get(fid), threshold) == 1, self.value(get, k, 2 * node + 2)).otherwise(self.value(get, k, 2 * node + 1))
        return F.lit(float(self.leaves.get(node, [0.0] * (k + 1))[k]))

    def ids(self) -> list[int]:
        """All nodes, split or not; their places are the slots of a walk."""
        return sorted({0, *self.nodes, *self.leaves, *(c for n in self.nodes for c in (2 * n + 1, 2 * n + 2))})

    def links(self) -> tuple[list[int], list[int]]:
        """Of each slot the one of the left child, itself where there is none; and its feature, or -1."""
        ids = self.ids()
        slot = {n: i for i, n in enumerate(ids)}
        return [slot[2 * n + 1] if n in self.nodes else slot[n] for n in ids], [self.nodes[n][0] if n in self.nodes else -1 for n in ids]

    def depth(self) -> int:
        return max((int(n + 1).bit_length() for n in self.nodes), default=0)

    def walk(self) -> Column:
        """The slot that a binned row (fids, bins) reaches: by conditions, which are compiled, or for larger trees
        by a walk over a table of the nodes."""
        ids = self.ids()
        if len(self.nodes) <= FEW_NODES:
            slot = {n: i for i, n in enumerate(ids)}

            def down(n):
                if n not in self.nodes:
                    return F.lit(slot[n])
                fid, _, cut, _ = self.nodes[n]
                found = F.coalesce(F.get("bins", (F.array_position("fids", F.lit(fid)) - 1).cast("int")), F.lit(self.defaults.get(n, 0)))
                return F.when(found > cut, down(2 * n + 2)).otherwise(down(2 * n + 1))

            return down(0)
        left, fids = self.links()
        whole = lambda xs: V.literal(xs).cast("array<int>")
        table = [whole(left), whole(fids), whole([self.nodes[n][2] if n in self.nodes else 0 for n in ids]), whole([self.defaults.get(n, 0) for n in ids])]

        def step(slot, _):
            child, fid, cut, default = (F.get(t, slot) for t in table)
            found = F.coalesce(F.get("bins", (F.array_position("fids", fid) - 1).cast("int")), default)
            return F.when(fid < 0, slot).otherwise(child + (found > cut).cast("int"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, self.depth()))), F.lit(0), step)


@dataclass
class Forest:
    """All trees' nodes as flat arrays: trees one after another, a left child followed by the right one."""

    root: np.ndarray
    left: np.ndarray
    place: np.ndarray  # of the feature among `fids`
    threshold: np.ndarray
    weights: np.ndarray
    fids: np.ndarray
    depth: int

    @classmethod
    def of(cls, trees: list[Tree], width: int) -> Forest:
        root, left, fids, threshold, weights = [], [], [], [], []
        for tree in trees:
            root.append(len(left))
            ids, (links, features) = tree.ids(), tree.links()
            left += [root[-1] + x for x in links]
            fids += features
            threshold += [tree.nodes[n][1] if n in tree.nodes else np.inf for n in ids]  # nothing goes right of a leaf
            weights += [(list(tree.leaves.get(n, [])) + [0.0] * width)[:width] for n in ids]
        kinds, place = np.unique(np.array(fids or [-1], np.int64), return_inverse=True)
        return cls(np.array(root, np.int64), np.array(left, np.int64), place, np.array(threshold, float), np.array(weights, float).reshape(-1, width), kinds, max((t.depth() for t in trees), default=0))

    def leaves(self, offsets: np.ndarray, indices: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The slot of each tree that each sparse row reaches; absent and NaN entries are zeros."""
        rows = len(offsets) - 1
        dense = np.zeros((rows, len(self.fids)))
        at = np.minimum(np.searchsorted(self.fids, indices), len(self.fids) - 1)
        known = self.fids[at] == indices
        row = np.repeat(np.arange(rows), np.diff(offsets))
        dense[row[known], at[known]] = np.nan_to_num(values[known], nan=0.0, posinf=np.inf, neginf=-np.inf)
        node = np.broadcast_to(self.root, (rows, len(self.root))).copy()
        here = np.arange(rows)[:, None]
        for _ in range(self.depth):
            node = self.left[node] + (dense[here, self.place[node]] >= self.threshold[node])
        return node


def score_rows(data: DataFrame, trees: list[Tree], width: int, combine, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, score): combine makes of the leaves' weights (rows, trees, width) an array of scores
    (rows, width). Rows go through the table of nodes some thousand at a time."""
    forest = Forest.of(trees, width)
    step = max(1, (1 << 21) // max(1, len(forest.fids), len(trees) * width))
    keep = keep or ["row_id"]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                row, indices, values = V.entries(part.column(len(keep)), part.column(len(keep) + 1))
                node = forest.leaves(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))), indices, values)
                out = combine(forest.weights[node])
                score = pa.array(out[:, 0]) if width == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * width, pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], score], [*keep, "score"])

    kept = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in keep)
    return data.select(*keep, "indices", "values").mapInArrow(run, f"{kept}, score {'double' if width == 1 else 'array<double>'}")


class GBDT(Supervised):
    name = "GBDT"
    voting = False

    @classmethod
    def defaults(cls) -> dict:
        return {
            "max_depth": 4, "max_node_num": -1, "leafwise": False, "num_split": 10, "ins_sp_ratio": 1.0, "feat_sp_ratio": 1.0, "is_regression": False, "num_label": 2, "num_round": 10, "learning_rate": 0.1,
            "min_split_gain": 0.0, "min_node_ins": 1024, "min_child_weight": 0.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "max_leaf_weight": 0.0, "multi_tree": False, "loss": "auto", "metrics": "auto", "seed": 0,
            "exact_splits": False, "full_hessian": False,
        }

    def check(self) -> None:
        p = self.params
        require(p["max_depth"] > 0 and 1 <= p["num_split"] <= 255, "max_depth must be positive, num_split 1 to 255")
        require(0 < p["ins_sp_ratio"] <= 1 and 0 < p["feat_sp_ratio"] <= 1, "sampling ratios are in (0, 1]")
        require(p["is_regression"] or p["num_label"] >= 2, "num_label must be at least 2")
        require(p["num_round"] > 0 and p["learning_rate"] > 0 and p["min_node_ins"] >= 0, "rounds and rates must be positive")
        require(not (self.voting and p["multi_tree"]), "a voting forest has one tree a round")
        if p["loss"] == "auto":
            p["loss"] = "square" if p["is_regression"] else "logistic"
        if p["metrics"] == "auto":
            p["metrics"] = "mse" if p["is_regression"] else "log-loss,precision" if p["num_label"] == 2 else "cross-entropy,precision"
        losses.rich_loss(p["loss"])
        self.regression = p["is_regression"]
        require(not p["full_hessian"] or (self.width > 1 and not p["multi_tree"] and p["loss"] == "logistic"), "full second derivatives are those of the logistic loss of several classes")
        cap = 2 ** (p["max_depth"] + 1) - 1
        p["max_node_num"] = cap if p["max_node_num"] <= 0 else min(cap, p["max_node_num"])

    @property
    def width(self) -> int:
        """Scores per row."""
        return 1 if self.regression or self["num_label"] == 2 else self["num_label"]

    def _prepare(self, train: DataFrame) -> DataFrame:
        """Binned rows (row_id, label, fids, bins); sets `splits`, a table of the features' edges."""
        rows = rows_of(train)
        if not self.regression:
            rows = stats.check_labels(rows, self["num_label"])
        self.splits = materialize(stats.candidate_splits(to_long(rows), self["num_split"], self["exact_splits"]), "splits")
        return stats.bin_rows(rows, self.splits, ["row_id", "label"])

    def _start(self, rows: DataFrame) -> list[float]:
        if self.regression or self.voting:
            return [0.0] * self.width
        counts = {r.label: r.n for r in stats.label_counts(rows).collect()}  # one row per class
        total, k = max(1, sum(counts.values())), self["num_label"]
        share = [self["learning_rate"] * (counts.get(c, 0) / total - 1 / k) for c in range(k)]
        return share[1:2] if k == 2 else share

    def _gradients(self, rows: DataFrame) -> DataFrame:
        """rows with g and h: arrays of the first and second derivatives by class, or packed second ones."""
        loss, y = losses.rich_loss(self["loss"]), F.col("label")
        if self.width == 1:
            s = F.get("pred", F.lit(0))
            return rows.withColumn("g", F.array(loss.grad(y, s))).withColumn("h", F.array(loss.hess(y, s)))
        h = losses.full_hessian(F.col("pred")) if self["full_hessian"] else loss.hessians(y, F.col("pred"), self.width)
        return rows.withColumn("g", loss.grads(y, F.col("pred"), self.width)).withColumn("h", h)

    def fit(self, train: DataFrame, valid: DataFrame | None = None) -> GBDT:
        rows = materialize(self._prepare(train), "binned")
        self.start, self.trees, self.history = self._start(rows), [], []
        begun = lambda df: df.withColumn("pred", V.literal(self.start)).withColumn("votes", V.literal([0.0] * self.width))
        state = materialize(self._gradients(begun(rows)), "round")
        held = None
        if valid is not None:  # validation rows carry their predictions as well
            held = begun(materialize(stats.bin_rows(rows_of(valid), self.splits, ["row_id", "label"]), "valid"))
        for turn in range(self["num_round"]):
            for c in range(self.width if self["multi_tree"] else 1):
                tree = self._grow(state, turn * self.width + c, [c] if self["multi_tree"] else list(range(self.width)))
                self.trees.append(tree)
                new = self._add(state if c == 0 else new, tree, c)
                held = None if held is None else self._add(held, tree, c)
            if turn + 1 < self["num_round"]:
                new = new if self.voting else self._gradients(new.drop("g", "h"))
                state = new = materialize(new, "round")
                held = None if held is None else materialize(held, "valid")
            self._measure(turn, new, "train")
            if held is not None:
                self._measure(turn, held, "valid")
        return self

    def _measure(self, turn: int, rows: DataFrame, split: str) -> None:
        """The metrics of a round, on carried predictions."""
        names = [m for m in str(self["metrics"]).split(",") if m]
        if names:
            score = F.transform("votes", lambda v: v / (turn + 1)) if self.voting else F.col("pred")
            rows = rows.select("label", (score if self.width > 1 else F.get(score, F.lit(0))).alias("score"))
            found = M.evaluate(rows, names, "multi" if self.width > 1 else self.family()).first().asDict()
            self.history += [(turn, split, k, v) for k, v in found.items()]

    def _add(self, rows: DataFrame, tree: Tree, c: int) -> DataFrame:
        """rows with the tree's part in `pred`, or in `votes`."""
        steps = []
        for node in tree.ids():
            w = [float(x) for x in tree.leaves.get(node, [0.0] * self.width)]
            if self.voting:
                steps.append(w if self.regression else [1.0 if w[0] > 0 else -1.0] if self.width == 1 else [float(k == max(range(self.width), key=w.__getitem__)) for k in range(self.width)])
            elif self["multi_tree"]:
                steps.append([self["learning_rate"] * w[0] if k == c else 0.0 for k in range(self.width)])
            else:
                steps.append([self["learning_rate"] * x for x in w])
        step = F.get(F.from_json(F.lit(json.dumps(steps)), "array<array<double>>"), tree.walk())
        name = "votes" if self.voting else "pred"
        return rows.withColumn(name, F.zip_with(name, step, lambda a, b: a + b))

    def _histogram(self, rows: DataFrame, tree: Tree, nodes: list[int], classes: list[int], used: Column | None) -> DataFrame:
        """(node, fid, bin, n, g.., h..) of some nodes; feature -1 has the nodes' totals."""
        slots = {n: i for i, n in enumerate(tree.ids())}
        node = F.get(V.literal(tree.ids()).cast("array<int>"), tree.walk())
        rows = rows.where(F.col("sampled")).withColumn("node", node).where(F.col("node").isin([n for n in nodes if n in slots]))
        kinds = len(classes) if not self["full_hessian"] else self.width * (self.width + 1) // 2
        entries = F.concat(F.array(F.struct(F.lit(-1).alias("fids"), F.lit(0).alias("bins"))), F.arrays_zip("fids", "bins"))
        entries = F.filter(entries, lambda e: (e["fids"] < 0) | used(e["fids"])) if used is not None else entries
        g, h = [F.get("g", F.lit(c)) for c in classes], [F.get("h", F.lit(c)) for c in (range(kinds) if self["full_hessian"] else classes)]
        long = rows.select("node", *[x.alias(f"g{i}") for i, x in enumerate(g)], *[x.alias(f"h{i}") for i, x in enumerate(h)], F.explode(entries).alias("e"))
        names = self._sums(classes)
        return long.groupBy("node", F.col("e.fids").alias("fid"), F.col("e.bins").alias("bin")).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in names[1:]])

    def _sums(self, classes: list[int]) -> list[str]:
        k = len(classes)
        return ["n", *[f"g{i}" for i in range(k)], *[f"h{i}" for i in range(k * (k + 1) // 2 if self["full_hessian"] else k)]]

    def _siblings(self, before: DataFrame, built: DataFrame, build: list[int], wanted: list[int], names: list[str]) -> DataFrame:
        """Histograms of the built nodes' siblings: what the parents have beyond the built ones."""
        other = {n: n + 1 if n % 2 else n - 1 for n in build}
        both = [n for n in build if other[n] in wanted]
        if not both:
            return built
        renamed = lambda df, key: df.where(F.col("node").isin(list(key))).withColumn("node", F.element_at(F.map_from_arrays(V.literal(list(key)).cast("array<int>"), V.literal(list(key.values())).cast("array<int>")), F.col("node")))
        parents = renamed(before, {(n - 1) // 2: other[n] for n in both})
        minus = renamed(built, {n: other[n] for n in both}).withColumns({x: -F.col(x) for x in names})
        left = parents.unionByName(minus).groupBy("node", "fid", "bin").agg(*[F.sum(x).alias(x) for x in names])
        return built.unionByName(left.where("n > 0"))

    def _grow(self, state: DataFrame, seed: int, classes: list[int]) -> Tree:
        """One tree over the given score slots. `scanned` has how many rows each level's aggregate read."""
        p, tree = self.params, Tree()
        rows = state.withColumn("sampled", stats.drawn(state.select("row_id"), p["ins_sp_ratio"], self["seed"] * 7919 + seed) if p["ins_sp_ratio"] < 1 else F.lit(True))
        used = None
        if p["feat_sp_ratio"] < 1:
            share = int(p["feat_sp_ratio"] * (1 << 30))
            used = lambda fid: F.pmod(F.xxhash64(F.lit(self["seed"]), F.lit(seed), fid), F.lit(1 << 30)) < share
        names = self._sums(classes)
        hist = materialize(self._histogram(rows, tree, [0], classes, used), "histogram")
        first = hist.where("fid = -1").first()
        totals = {0: [first[x] for x in names] if first else [0] * len(names)}
        self.scanned = [totals[0][0]]
        searched, found, count = [0], {}, 1
        while count + 2 < p["max_node_num"]:
            able = [n for n in searched if totals[n][0] > p["min_node_ins"] and self._heavy(totals[n], len(classes)) and n < 2 ** p["max_depth"] - 1]
            found |= self._find(hist, able, classes) if able else {}
            order = sorted(found, key=lambda n: (-found[n]["gain"], n))
            chosen = order[:1] if p["leafwise"] else order[: (p["max_node_num"] - count) // 2]
            if not chosen:
                break
            for n in chosen:
                best = found.pop(n)
                tree.nodes[n] = (best["fid"], best["threshold"], best["bin"], best["gain"])
                tree.defaults[n] = best["default_bin"]
                totals[2 * n + 1], totals[2 * n + 2] = best["left"], best["right"]
            if not p["leafwise"]:
                found = {}
            count += 2 * len(chosen)
            searched = sorted(c for n in chosen for c in (2 * n + 1, 2 * n + 2))
            if count + 2 >= p["max_node_num"]:
                break
            # of each pair with a child that may split, the smaller one is built
            wanted = [n for n in searched if totals[n][0] > p["min_node_ins"] and n < 2 ** p["max_depth"] - 1]
            pairs = sorted({(n - 1) // 2 for n in wanted})
            if pairs:
                build = [2 * n + 1 if totals[2 * n + 1][0] < totals[2 * n + 2][0] else 2 * n + 2 for n in pairs]
                self.scanned.append(sum(totals[n][0] for n in build))
                built = materialize(self._histogram(rows, tree, build, classes, used), "built")
                new = self._siblings(hist, built, build, wanted, names)
                # a leaf-wise tree still holds splits of other nodes
                hist = materialize(new.unionByName(hist.where(F.col("node").isin(list(found)))) if found else new, "histogram")
        for n in set(tree.ids()) - set(tree.nodes):
            tree.leaves[n] = self._leaf_weights(totals[n], len(classes))
        return tree

    def _heavy(self, sums: list[float], k: int) -> bool:
        """The hessian test of a node: the value, or the product of the diagonal."""
        h = sums[1 + k :]
        diagonal = [h[V.lower_index(i, i)] for i in range(k)] if self["full_hessian"] else h
        return not self["min_child_weight"] or float(np.prod(diagonal)) > self["min_child_weight"]

    def _leaf_weights(self, sums: list[float], k: int) -> list[float]:
        p, g, h = self.params, sums[1 : 1 + k], sums[1 + k :]
        if self["full_hessian"]:
            w = -V.solve_packed(np.array([h], float), np.array([g], float), p["reg_lambda"])[0]
            return np.nan_to_num(w, nan=0.0).tolist()
        return [self._leaf(a, b) for a, b in zip(g, h)]

    def _leaf(self, g: float, h: float) -> float:
        p = self.params
        if h <= p["min_child_weight"]:
            return 0.0
        t = max(abs(g) - p["reg_alpha"], 0.0) * (1 if g > 0 else -1)
        w = -t / (h + p["reg_lambda"])
        return max(-p["max_leaf_weight"], min(p["max_leaf_weight"], w)) if p["max_leaf_weight"] else w

    def _find(self, hist: DataFrame, able: list[int], classes: list[int]) -> dict[int, dict]:
        """Best split of each node: fid, bin, threshold, default_bin, gain, and both sides' sums."""
        p, k, names = self.params, len(classes), self._sums(classes)
        here = hist.where(F.col("node").isin(able))
        entries = here.where("fid >= 0").join(self.splits.select("fid", "default_bin"), "fid")
        # the default bin has what a node's total has beyond the entries that are there
        seen = entries.groupBy("node", "fid", F.col("default_bin").alias("bin")).agg(*[F.sum(x).alias(x) for x in names])
        whole = here.where("fid = -1").select("node", *[F.col(x).alias(f"t_{x}") for x in names])
        rest = seen.join(F.broadcast(whole), "node").select("node", "fid", "bin", *[(F.col(f"t_{x}") - F.col(x)).alias(x) for x in names]).where("n > 0")  # a row a node
        sums = prefix_sums(entries.select("node", "fid", "bin", *names).unionByName(rest), names).where("l_n > 0 and r_n > 0")
        sides = lambda s, x: [F.col(f"{s}_{x}{i}") for i in range(k)]
        if p["min_child_weight"]:
            diagonal = lambda s: [F.col(f"{s}_h{V.lower_index(i, i)}") for i in range(k)] if p["full_hessian"] else sides(s, "h")
            for s in "lr":
                sums = sums.where(V.product(F.array(*diagonal(s))) > p["min_child_weight"])
        if p["full_hessian"]:
            gains = full_gains(sums, k, p["reg_lambda"])
        else:
            clip = p["max_leaf_weight"] if k == 1 else 0.0  # of one score only
            mean = lambda s: sum((node_gain(g, h, p["reg_lambda"], p["reg_alpha"], clip) for g, h in zip(sides(s, "g"), sides(s, "h"))), F.lit(0.0)) / k
            gains = sums.withColumn("gain", mean("l") + mean("r") - mean("t") - p["reg_lambda"])
        key = F.struct("gain", -F.col("fid"), -F.col("bin"), "fid", "bin", F.array(*[F.col(f"l_{x}").cast("double") for x in names]).alias("left"), F.array(*[F.col(f"r_{x}").cast("double") for x in names]).alias("right"))
        best = gains.where(F.col("gain") > p["min_split_gain"]).groupBy("node").agg(F.max(key).alias("s")).select("node", "s.*")
        best = best.join(self.splits, "fid").withColumn("threshold", F.get("edges", F.col("bin") + 1))
        return {r.node: r.asDict() for r in best.select("node", "fid", "bin", "threshold", "default_bin", "gain", "left", "right").collect()}  # one row a node

    def predict_score(self, data: DataFrame) -> DataFrame:
        width, rate, start, one = self.width, self["learning_rate"], np.array(self.start, float), self["multi_tree"]

        def combine(weights):
            if one:  # a tree has one class's weight
                out = np.zeros((len(weights), width))
                for c in range(width):
                    out[:, c] = rate * weights[:, c::width, 0].sum(axis=1)
                return start + out
            return start + rate * weights.sum(axis=1)

        return score_rows(data, self.trees, width, combine)

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = [(i, n, False, f, t, b, g, []) for i, tree in enumerate(self.trees) for n, (f, t, b, g) in tree.nodes.items()]
        rows += [(i, n, True, None, None, None, None, [float(x) for x in w]) for i, tree in enumerate(self.trees) for n, w in tree.leaves.items()]
        schema = "tree_id int, node_id int, is_leaf boolean, fid int, threshold double, bin int, gain double, weights array<double>"
        return {"trees": spark.createDataFrame(rows, schema), "start": spark.createDataFrame([(self.start,)], "start array<double>")}

    def restore(self, parts: dict[str, DataFrame]) -> None:
        self.start = list(parts["start"].first().start)
        rows = parts["trees"].orderBy("tree_id", "node_id").collect()
        self.trees = [Tree() for _ in range(1 + max((r.tree_id for r in rows), default=-1))]
        for r in rows:
            if r.is_leaf:
                self.trees[r.tree_id].leaves[r.node_id] = list(r.weights)
            else:
                self.trees[r.tree_id].nodes[r.node_id] = (r.fid, r.threshold, r.bin, r.gain)


class RandomBoostedForest(GBDT):
    """Trees on the gradients of the first round, sampled rows and features; their signs vote."""

    name, voting = "RandomBoostedForest", True

    @classmethod
    def defaults(cls) -> dict:
        return {**super().defaults(), "ins_sp_ratio": 0.3, "feat_sp_ratio": 0.3, "num_round": 100}

    def predict_score(self, data: DataFrame) -> DataFrame:
        """The mean of the trees: of their weights, of the signs (1 for a positive leaf, else -1), or of the first
        largest class."""
        width, n, plain = self.width, max(1, len(self.trees)), self.regression

        def combine(weights):
            if plain:
                return weights.sum(axis=1) / n
            if width == 1:
                return np.where(weights > 0, 1.0, -1.0).sum(axis=1) / n
            return (weights.argmax(axis=2)[:, :, None] == np.arange(width)).sum(axis=1) / n

        return score_rows(data, self.trees, width, combine)
