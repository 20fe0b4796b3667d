"""Matrix factorisation by stochastic gradients, its statistics and metrics.

Users and items are dealt into B groups each; in sub-step s the tiles (i, (i + s) mod B) share no
factor row, so each runs alone in one task with the factors that its ratings need. B follows the number
of ratings, so a tile's size is bounded. A factor row goes from a tile to the next one that has a rating of
it, so no more rows are moved than there are ratings on both sides.

With `workers`, and in pairwise fits, an epoch is one step instead: every worker has a share of the
ratings, or of triples with a drawn negative, and a local model of the rows that these need; rows that
several workers hold become the mean of theirs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..sources import persist
from ..sources.storage import Routed, materialize
from .neighbors import block_groups
from .params import Params, frame_of, require

TILE_RATINGS = 200_000
FACTORS = "kind int, id bigint, f array<double>, slow double, fast double"
#: Bits of a word in a set of sub-steps.
WORD = 62

# Residual of ratings r and predictions p: minus the loss's derivative by p.
OBJECTIVES: dict[str, Callable] = {
    "l2": lambda r, p: r - p,
    "l1": lambda r, p: np.sign(r - p),
    "kl": lambda r, p: r / np.maximum(p, 1e-10) - 1,
    "logistic": lambda r, p: np.where(r > 0, r / (1 + np.exp(r * p)), -1 / (1 + np.exp(-p))),
    "squared-hinge": lambda r, p: np.where(r > 0, 1, -1) * np.maximum(0.0, 1 - np.where(r > 0, 1, -1) * p),
    # pairwise: a positive against a drawn one; p is the difference of the scores
    "bpr": lambda r, p: 1 / (1 + np.exp(p)),
    "hinge": lambda r, p: np.where(np.where(r > 0, 1, -1) * p < 1, np.where(r > 0, 1.0, -1.0), 0.0),
}


def rating_stats(ratings: DataFrame) -> DataFrame:
    """One row (n, mean, std)."""
    return ratings.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"))


def degrees(ratings: DataFrame, side: str) -> DataFrame:
    return ratings.groupBy(side).agg(F.count("*").alias("omega"))


def predict(pairs: DataFrame, p: DataFrame, q: DataFrame, bias: float, classify: bool = False) -> DataFrame:
    """pairs (u, v, ...) with `pred`: the factors' inner product, the bias where a side is unknown."""
    joined = pairs.join(p.select(F.col("id").alias("u"), F.col("factors").alias("__p")), "u", "left").join(q.select(F.col("id").alias("v"), F.col("factors").alias("__q")), "v", "left")
    value = F.coalesce(V.dot("__p", "__q"), F.lit(float(bias)))
    return joined.withColumn("pred", F.when(value > 0, F.lit(1.0)).otherwise(F.lit(-1.0)) if classify else value).drop("__p", "__q")


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "mse": lambda r, p: F.avg((r - p) * (r - p)),
    "rmse": lambda r, p: F.sqrt(F.avg((r - p) * (r - p))),
    "mae": lambda r, p: F.avg(F.abs(r - p)),
    "gkl": lambda r, p: F.avg(r * F.log(r / F.greatest(p, F.lit(1e-10))) - r + p),
    "logloss": lambda r, p: F.avg(F.when(r > 0, F.log1p(F.exp(-p))).otherwise(F.log1p(F.exp(p)))),
    "accuracy": lambda r, p: F.avg(F.when((r > 0) == (p > 0), 1.0).otherwise(0.0)),
}


def evaluate(scored: DataFrame, names: list[str]) -> DataFrame:
    return scored.agg(*[METRICS[n](F.col("r"), F.col("pred")).alias(n) for n in names])


ERRORS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": lambda r, p: (r - p) * (r - p),
    "l1": lambda r, p: F.abs(r - p),
    "kl": lambda r, p: r * F.log(r / p) - r + p,
    "logistic": lambda r, p: F.log1p(F.exp(F.when(r > 0, -p).otherwise(p))),
    # right decisions
    "squared-hinge": lambda r, p: F.when(F.when(r > 0, p > 0).otherwise(p < 0), 1.0).otherwise(0.0),
    "hinge": lambda r, p: F.when(F.when(r > 0, p > 0).otherwise(p < 0), 1.0).otherwise(0.0),
}


def error_sums(scored: DataFrame, objectives: list[str]) -> DataFrame:
    """(objective, error): each pointwise objective's sum over (r, pred), in one pass."""
    sums = [F.struct(F.lit(n).alias("objective"), F.coalesce(F.sum(ERRORS[n](F.col("r"), F.col("pred"))), F.lit(0.0)).alias("error")) for n in objectives]
    return scored.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.objective", "s.error")


def pairwise_error(triples: DataFrame, p: DataFrame, q: DataFrame, bias: float, by: str = "u") -> DataFrame:
    """One row: the sum over (u, v, w) of log(1 + exp(the drawn one's score minus the positive's)); w is an item,
    or with by="v" a user."""
    good = predict(triples, p, q, bias).withColumnRenamed("pred", "good")
    other, asked = ("v", "u") if by == "u" else ("u", "v")
    drawn = good.select(F.col(asked), F.col("w").alias(other), "good")
    bad = predict(drawn, p, q, bias)
    return bad.agg(F.coalesce(F.sum(F.log1p(F.exp(F.col("pred") - F.col("good")))), F.lit(0.0)).alias("error"))


def penalty(factors: DataFrame, omega: DataFrame, l1: float, l2: float) -> DataFrame:
    """Sum over rows of degree times (l1 |f| + l2 |f|^2)."""
    size = l1 * V.total(F.transform("factors", F.abs)) + l2 * V.dot("factors", "factors")
    return factors.join(omega, "id").agg(F.coalesce(F.sum(F.col("omega") * size), F.lit(0.0)).alias("penalty"))


def rank_metrics(positives: DataFrame, scored: DataFrame, by: str = "u", item: str = "v") -> DataFrame:
    """Per row: AUC and mean percentile rank of its positives among all items scored for it.

    scored (by, item, pred) lists the candidates; a rank window per row counts the candidates below
    each positive.
    """
    w = Window.partitionBy(by).orderBy("pred")
    marked = scored.join(positives.select(by, item, F.lit(1).alias("pos")), [by, item], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    ranked = marked.withColumn("below", F.rank().over(w) - 1).withColumn("level", F.count("*").over(Window.partitionBy(by, "pred")))
    ranked = ranked.withColumn("pos_below", F.sum("pos").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("pos").over(Window.partitionBy(by, "pred"))).withColumn("pos_level", F.sum("pos").over(Window.partitionBy(by, "pred")))
    won = F.col("below") - F.col("pos_below") + 0.5 * (F.col("level") - F.col("pos_level"))
    sums = ranked.groupBy(by).agg(F.sum("pos").alias("n_pos"), F.count("*").alias("n"), F.sum(F.when(F.col("pos") == 1, won)).alias("won"), F.sum(F.when(F.col("pos") == 1, F.col("below"))).alias("ranks"))
    rows = sums.where("n_pos > 0 and n_pos < n")
    return rows.select(by, (F.col("won") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("auc"), (1 - F.col("ranks") / (F.col("n_pos") * (F.col("n") - 1))).alias("mpr"))


#: Rows of a block, and a row's positives that are taken together.
RANK_ROWS, RANK_POSITIVES = 4096, 4096


def _lost(batches):
    """(id, le) of each row with some of its positives: over the classes of items of a block, the sum of how many of
    these are not above the items' prediction, times the items (their `id`)."""
    for items, rows in block_groups(batches):
        if items.num_rows and rows.num_rows:
            q, many = np.array(items.column("f").to_pylist(), float), items.column("id").to_numpy()
            ids, counts = rows.column("id"), []
            for lo in range(0, rows.num_rows, 256):
                part = rows.slice(lo, 256)
                p = np.array(part.column("f").to_pylist(), float)
                score = np.zeros((len(p), len(q)))
                for k in range(p.shape[1]):  # in the order of the predictions of the positives
                    score += p[:, k, None] * q[None, :, k]
                counts += [int(np.searchsorted(np.array(own), s, side="right") @ many) for own, s in zip(part.column("preds").to_pylist(), score)]
            yield pa.RecordBatch.from_arrays([ids.chunk(0), pa.array(counts, pa.int64())], ["id", "le"])


def item_ranks(ratings: DataFrame, p: DataFrame, q: DataFrame, bias: float, by: str = "u") -> DataFrame:
    """(id, n_pos, n_neg, lost, auc) of each user (by="u") or item (by="v") that has positive ratings, held against
    all of the other side without one: lost counts the pairs in which the positive is not above. Ids
    without factors are predicted as `bias`.

    Both sides' factors meet in blocks of a shuffle, in which sorted positives are searched for the predictions,
    so no pair is listed; many positives of one row go in pieces. Those of the other side with equal
    factors meet the rows once, as a class with its size.
    """
    own, other = (p, q) if by == "u" else (q, p)
    across = "v" if by == "u" else "u"
    positive = ratings.where("r > 0").select(F.col(by).alias("a"), F.col(across).alias("b")).distinct()
    every = ratings.select(F.col(across).alias("id")).union(other.select("id")).distinct().count()
    unknown = every - other.count()
    left, right = own.select(F.col("id").alias("a"), F.col("factors").alias("f")), other.select(F.col("id").alias("b"), F.col("factors").alias("__o"))
    scored = positive.join(left, "a", "left").join(right, "b", "left").select("a", "b", F.coalesce(V.dot("f", "__o"), F.lit(float(bias))).alias("pred"))
    scored = materialize(scored, "positives")
    until = Window.partitionBy("a").orderBy("pred").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = scored.withColumn("own", F.count("*").over(until)).groupBy("a").agg(F.count("*").alias("n_pos"), F.sum("own").alias("own"), F.sum((F.col("pred") <= bias).cast("bigint")).alias("at_bias"))
    sums = materialize(sums, "sums")
    pieces = F.ceil(F.col("n_pos") / RANK_POSITIVES)
    parts = scored.join(sums.select("a", pieces.alias("pieces")), "a").groupBy("a", F.pmod(F.xxhash64("b"), "pieces").alias("piece")).agg(F.sort_array(F.collect_list("pred")).alias("preds"))  # a piece's
    rows = materialize(parts.join(left, "a"), "rows")
    classes = materialize(right.groupBy("__o").agg(F.count("*").alias("many")), "classes")
    cuts, turns = max(1, -(-classes.count() // RANK_ROWS)), max(1, -(-rows.count() // RANK_ROWS))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    none = F.lit(None).cast("array<double>")
    items = classes.select(copies(turns).alias("i"), place(cuts, "__o").alias("j"), F.lit(0).alias("side"), F.col("many").alias("id"), F.col("__o").alias("f"), none.alias("preds"))
    asked = rows.select(place(turns, "a", "piece").alias("i"), copies(cuts).alias("j"), F.lit(1).alias("side"), F.col("a").cast("bigint").alias("id"), "f", "preds")
    groups = items.union(asked).repartition(turns * cuts, "i", "j").sortWithinPartitions("i", "j", "side")
    met = groups.mapInArrow(_lost, "id bigint, le bigint").groupBy("id").agg(F.sum("le").alias("le"))
    joined = sums.join(met, F.col("a") == F.col("id"), "left")
    n_neg = F.lit(every) - F.col("n_pos")
    # a row without factors has ties alone
    lost = F.when(F.col("known").isNull(), F.col("n_pos") * n_neg).otherwise(F.coalesce("le", F.lit(0)) + F.lit(unknown) * F.col("at_bias") - F.col("own"))
    joined = joined.join(own.select(F.col("id").alias("known")), F.col("a") == F.col("known"), "left").withColumn("n_neg", n_neg).withColumn("lost", lost).where("n_neg > 0")
    return joined.select(F.col("a").alias("id"), "n_pos", "n_neg", "lost", (1 - F.col("lost") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def rank_summary(ranks: DataFrame) -> DataFrame:
    """(mpr, auc): the lost pairs' shares over all positives, and the mean of the rows' AUC."""
    return ranks.agg((F.sum(F.col("lost") / F.col("n_neg")) / F.sum("n_pos")).alias("mpr"), F.avg("auc").alias("auc"))


def tile(u: Column, v: Column, groups: int, seg_u: int, seg_v: int) -> Column:
    """Number of the grid tile of a rating when ids are cut into runs."""
    return (F.floor(u / seg_u) * groups + F.floor(v / seg_v)).cast("int")


class NMF:
    """Non-negative (or plain) factorisation with adaptive steps."""

    name = "NMF"

    def __init__(self, embedding_dim: int = 8, num_epoch: int = 10, learning_rate: float = 0.1, l1_reg: float = 0.0, l2_reg: float = 0.0, parallel: bool = False, objective: str = "l2", nonnegative: bool = True, seed: int = 0, workers: int = 0, by: str = "u"):
        """workers: how many local models an epoch averages, none for disjoint tiles (a pairwise fit has at least one,
        and as many as its size asks for); by: whose negatives a pairwise fit draws, a user's items ("u") or
        an item's users ("v")."""
        require(embedding_dim > 0 and num_epoch > 0 and learning_rate > 0, "dimension, epochs and rate must be positive")
        require(objective in OBJECTIVES, f"no such objective: {objective}")
        require(l1_reg >= 0 and l2_reg >= 0 and workers >= 0, "regularisation and workers must not be negative")
        require(by in ("u", "v") and (by == "u" or objective == "bpr"), "by is u, or v in a pairwise fit")
        self.params = Params(embedding_dim=embedding_dim, num_epoch=num_epoch, learning_rate=learning_rate, l1_reg=l1_reg, l2_reg=l2_reg, objective=objective, nonnegative=nonnegative, seed=seed, workers=workers, by=by)
        self.history: list[tuple] = []

    def fit(self, ratings: DataFrame, valid: DataFrame | None = None) -> NMF:
        p, ratings, valid = self.params, frame_of(ratings), frame_of(valid)
        n, mean, std = rating_stats(ratings).first()
        regression = p["objective"] in ("l2", "l1", "kl")
        scale = max(1e-4, std or 0.0) if regression else 1.0
        self.bias = float(mean or 0.0) if regression else 0.0
        groups = max(1, int(np.ceil(np.sqrt((n or 0) / TILE_RATINGS))))
        group = lambda c: F.pmod(F.xxhash64(F.lit(p["seed"]), F.col(c).cast("bigint")), F.lit(groups)).cast("int")
        data = ratings.select("u", "v", "r", group("u").alias("gu"), group("v").alias("gv"))
        pairwise = p["objective"] == "bpr"
        workers = max(p["workers"], -(-(n or 0) // TILE_RATINGS), 1) if pairwise else p["workers"]
        if workers:
            data = materialize(data.withColumn("r", F.col("r") / scale), "ratings")
            p_side, q_side = self._init(data, "u", "gu"), self._init(data, "v", "gv")
        else:
            tiles, factors = self._deal(data, groups, scale, group)
        if pairwise:  # every number may be drawn
            last = ratings.agg(F.max("v" if p["by"] == "u" else "u")).first()[0]
            every = ratings.sparkSession.range(0 if last is None else last + 1)
            p_side, q_side = (p_side, self._init(every.select(F.col("id").alias("v"), F.lit(0).alias("gv")), "v", "gv")) if p["by"] == "u" else (self._init(every.select(F.col("id").alias("u"), F.lit(0).alias("gu")), "u", "gu"), q_side)
        for epoch in range(p["num_epoch"]):
            if workers:
                p_side, q_side = self._averaged(data, p_side, q_side, workers, scale, epoch)
            else:
                for s in range(groups):
                    self._sub_step(tiles, factors, groups, s, scale, epoch)
                p_side, q_side = (factors.since((epoch + 1) * groups).where(F.col("kind") == kind) for kind in (0, 1))
            self.p = p_side.select("id", F.transform("f", lambda x: x * float(np.sqrt(scale))).alias("factors"))
            self.q = q_side.select("id", F.transform("f", lambda x: x * float(np.sqrt(scale))).alias("factors"))
            for split, part in (("train", ratings), ("valid", valid)):
                if pairwise and part is not None:
                    self.history.append((epoch, split, "auc", self.rank_metrics(part, p["by"]).first().auc))
                elif part is not None:
                    row = evaluate(self.predict(part), ["rmse"]).first()
                    self.history.append((epoch, split, "rmse", row.rmse))
        if not workers:
            tiles.close()
            factors.close()
        return self

    def _unit(self, side: str) -> Column:
        k = self.params["embedding_dim"]
        # a number of the row's own for each dimension: the same factors for any partitioning
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(F.xxhash64(F.lit(self.params["seed"]), F.lit(side), F.col(side), i), F.lit(1 << 30)) / float(1 << 30) * float(np.sqrt(1 / k)))

    def _init(self, data: DataFrame, side: str, group: str) -> DataFrame:
        ids = data.select(side, group).distinct()
        return ids.select(F.col(side).alias("id"), F.col(group).alias("grp"), self._unit(side).alias("f"), F.lit(1.0).alias("slow"), F.lit(1.0).alias("fast"))

    def _deal(self, data: DataFrame, groups: int, scale: float, group: Callable) -> tuple[Routed, Routed]:
        """The ratings by sub-step and tile, and the factor rows, each in the tile of its first rating. `steps` is the
        set of sub-steps that have ratings of a row, as bits."""
        spark, step = data.sparkSession, F.pmod(F.col("gv") - F.col("gu"), F.lit(groups))
        tiles, factors = Routed(spark, "tiles", "tile", groups), Routed(spark, "factors", "tile", groups)
        dealt = data.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), "r").repartition(group("v") - group("u"), group("u"))
        tiles.send(dealt.select("u", "v", (F.col("r") / scale).alias("r"), group("u").alias("tile"), F.pmod(group("v") - group("u"), F.lit(groups)).alias("turn")))
        bit = F.get(F.array(*[F.lit(1 << i).cast("bigint") for i in range(WORD)]), (step % WORD).cast("int"))
        words = [F.bit_or(F.when(F.floor(step / WORD) == w, bit).otherwise(F.lit(0).cast("bigint"))) for w in range(-(-groups // WORD))]
        # the first sub-step is the lowest bit
        lowest = F.coalesce(*[F.when(F.get("steps", F.lit(i)) != 0, F.log2(F.get("steps", F.lit(i)).bitwiseAND(-F.get("steps", F.lit(i)))).cast("int") + i * WORD) for i in range(len(words))])
        for kind, side, own in ((0, "u", group("u")), (1, "v", F.pmod(group("v") - F.col("turn"), F.lit(groups)))):
            rows = data.groupBy(side).agg(F.array(*words).alias("steps")).withColumn("turn", lowest)
            factors.send(rows.select(F.lit(kind).alias("kind"), F.col(side).cast("bigint").alias("id"), self._unit(side).alias("f"), F.lit(1.0).alias("slow"), F.lit(1.0).alias("fast"), "steps", own.alias("tile"), "turn"))
        return tiles, factors

    def _sub_step(self, tiles: Routed, factors: Routed, groups: int, s: int, scale: float, epoch: int) -> None:
        params = dict(self.params)
        schema = StructType.fromDDL(f"{FACTORS}, steps array<bigint>, tile int, turn int")
        arrow = to_arrow_schema(schema)

        def run(held: pa.Table, rows: pa.Table) -> pa.Table:
            flat = lambda c, kind, width: held[c].combine_chunks().flatten().to_numpy().astype(kind).reshape(len(held), width)
            held = held.sort_by([("kind", "ascending"), ("id", "ascending")])
            if not len(held):
                return arrow.empty_table()
            kind, ids, words = held["kind"].to_numpy(), held["id"].to_numpy(), flat("steps", np.int64, -1)
            f, paces = flat("f", float, params["embedding_dim"]), np.column_stack([held["slow"].to_numpy(), held["fast"].to_numpy()])
            cut = int(np.searchsorted(kind, 1))
            u, v, r = (rows[c].to_numpy() for c in ("u", "v", "r"))
            order = np.lexsort((r, v, u))
            u, v, r = u[order], v[order], r[order].astype(float)
            _rating_steps(params, scale, epoch, (np.searchsorted(ids[:cut], u), np.searchsorted(ids[cut:], v)), r, [(f[:cut], paces[:cut]), (f[cut:], paces[cut:])])
            turn = np.full(len(held), -1)
            for t in [*range(s + 1, groups), *range(s + 1)]:  # the next one, in this epoch or the one to come
                turn[(turn < 0) & ((words[:, t // WORD] >> (t % WORD)) & 1 == 1)] = (epoch + (t <= s)) * groups + t
            here = held["tile"][0].as_py()
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            out = {"kind": kind, "id": ids, "f": lists(f), "slow": paces[:, 0], "fast": paces[:, 1], "steps": lists(words), "tile": np.where(kind == 1, (here + s - turn) % groups, here), "turn": turn}
            return pa.table([pa.array(out[c.name]).cast(c.type) for c in arrow], schema=arrow)

        held, rows = factors.at(epoch * groups + s), tiles.at(s)
        factors.send(held.groupBy("tile").cogroup(rows.groupBy("tile")).applyInArrow(run, schema))

    def _averaged(self, data, p_side, q_side, workers, scale, epoch):
        """One epoch in local models: each worker's share of the ratings, or of triples, meets the factor rows that
        these need; what several workers hold becomes the mean. A frequent user is dealt to several."""
        p, by = self.params, self.params["by"]
        across, seed = "v" if by == "u" else "u", self.params["seed"]
        if p["objective"] == "bpr":
            positive = data.where("r > 0")
            last = data.agg(F.max(across)).first()[0]
            rows = bpr_pairs(positive, 0 if last is None else int(last) + 1, seed * 7919 + epoch, by, rated=data).withColumn("r", F.lit(None).cast("double"))
        else:
            rows = data.select("u", "v", F.lit(None).cast("bigint").alias("w"), "r")
        rows = materialize(rows.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"), F.col("w").cast("bigint").alias("w"), "r"), "shares")
        often = rows.groupBy(by).agg(F.ceil(F.count("*") / TILE_RATINGS).alias("pieces")).where("pieces > 1")
        rows = rows.join(often, by, "left").withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), by, F.pmod(F.xxhash64(across), F.coalesce("pieces", F.lit(1)))), F.lit(workers)).cast("int")).drop("pieces")
        users = rows.select("rank", F.col("u").alias("id"))
        items = rows.select("rank", F.col("v").alias("id"))
        drawn = rows.where("w is not null").select("rank", F.col("w").alias("id"))
        users, items = (users, items.union(drawn)) if by == "u" else (users.union(drawn), items)
        none = lambda kind: F.lit(None).cast(kind)
        held = [need.distinct().join(side.withColumn("id", F.col("id").cast("bigint")), "id").select("rank", F.lit(kind).alias("kind"), F.col("id").alias("a"), none("bigint").alias("b"), none("bigint").alias("w"), none("double").alias("r"), "f", "slow", "fast") for kind, need, side in ((0, users, p_side), (1, items, q_side))]
        asked = rows.select("rank", F.lit(2).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), "w", "r", none("array<double>").alias("f"), none("double").alias("slow"), none("double").alias("fast"))
        work = _tile_worker(dict(p), scale, epoch)
        local = materialize(held[0].union(held[1]).union(asked).groupBy("rank").applyInPandas(work, FACTORS), "local")
        sides = []
        for kind, side in ((0, p_side), (1, q_side)):
            own = local.where(F.col("kind") == kind)
            mean = own.select("id", F.posexplode("f").alias("k", "x")).groupBy("id", "k").agg(F.avg("x").alias("x")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))  # one row's dimensions
            pace = own.groupBy("id").agg(F.avg("slow").alias("slow"), F.avg("fast").alias("fast"))
            new = mean.join(pace, "id").select("id", F.lit(0).alias("grp"), F.col("s.x").alias("f"), "slow", "fast")
            rest = side.withColumn("id", F.col("id").cast("bigint")).join(new.select("id"), "id", "left_anti").select("id", "grp", "f", "slow", "fast")
            sides.append(materialize(new.union(rest), "averaged"))
        return sides[0], sides[1]

    def predict(self, pairs: DataFrame) -> DataFrame:
        return predict(frame_of(pairs), self.p, self.q, self.bias, self.params["objective"] not in ("l2", "l1", "kl"))

    def rank_metrics(self, ratings: DataFrame, by: str = "u") -> DataFrame:
        """(mpr, auc) of the positive ratings against everything without one, by user or by item."""
        return rank_summary(item_ranks(frame_of(ratings), self.p, self.q, self.bias, by))

    def save_model(self, spark: SparkSession, path: str) -> None:
        persist.save(spark, path, self.name, {**self.params, "bias": self.bias}, {"p": self.p, "q": self.q})

    @classmethod
    def load_model(cls, spark: SparkSession, path: str) -> NMF:
        params, parts = persist.load(spark, path, cls.name)
        bias = params.pop("bias")
        model = cls(**params)
        model.bias, model.p, model.q = bias, parts["p"], parts["q"]
        return model


def _waves(u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Places of ratings (rows u and v of the two sides) in waves: a rating comes in the first wave after those of all
    earlier ratings that share a row with it. So no two of a wave do, and steps wave by wave are those one by one."""
    next_u, next_v = [0] * (int(u.max(initial=-1)) + 1), [0] * (int(v.max(initial=-1)) + 1)
    waves = []
    for a, b in zip(u.tolist(), v.tolist()):
        wave = max(next_u[a], next_v[b])
        next_u[a] = next_v[b] = wave + 1
        waves.append(wave)
    waves = np.array(waves, np.int64)
    return np.split(np.argsort(waves, kind="stable"), np.cumsum(np.bincount(waves))[:-1])


def _rating_steps(params: dict, scale: float, epoch: int, at: tuple[np.ndarray, np.ndarray], values: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Steps of ratings of rows `at` of the two sides (factors, sums of squares), which are changed. The ratings come in
    ascending rows and values."""
    residual, lr, k = OBJECTIVES[params["objective"]], params["learning_rate"], params["embedding_dim"]
    l1, l2 = params["l1_reg"] / scale**1.5, params["l2_reg"] / scale
    slow_dims = min(8, k)
    order = np.random.default_rng([params["seed"], epoch]).permutation(len(values))
    (p, gp), (q, gq) = sides
    for wave in _waves(at[0][order], at[1][order]) if len(order) else []:
        i = order[wave]
        u, v = at[0][i], at[1][i]
        pu, qv = p[u], q[v]
        with np.errstate(over="ignore"):
            z = residual(values[i], np.einsum("ij,ij->i", pu, qv))[:, None]
        for rows, x, f, acc, g in ((u, pu, p, gp, -z * qv + l2 * pu), (v, qv, q, gq, -z * pu + l2 * qv)):
            for part, slot in ((slice(0, slow_dims), 0), (slice(slow_dims, k), 1)):
                if part.start >= k or (slot == 1 and epoch == 0 and not l1):
                    continue
                eta = (lr / np.sqrt(acc[rows, slot]))[:, None]
                step = x[:, part] - eta * g[:, part]
                if l1:
                    step = np.sign(step) * np.maximum(np.abs(step) - l1 * eta, 0)
                f[rows, part] = np.maximum(step, 0) if params["nonnegative"] else step
                acc[rows, slot] += (g[:, part] ** 2).mean(axis=1)


def _tile_worker(params: dict, scale: float, epoch: int):
    lr, k, l2 = params["learning_rate"], params["embedding_dim"], params["l2_reg"] / scale

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for kind in (0, 1):
            rows = pdf[pdf.kind == kind].sort_values("a")
            f = np.array(rows.f.tolist(), float).reshape(len(rows), k)
            sides.append((rows.a.to_numpy(int), f, rows[["slow", "fast"]].to_numpy(float).copy()))
        ratings = pdf[pdf.kind == 2].sort_values(["a", "b", "r"] + (["w"] if "w" in pdf else []))
        at = [np.searchsorted(sides[i][0], ratings[c].to_numpy(int)) for i, c in ((0, "a"), (1, "b"))]
        (_, p, gp), (_, q, gq) = sides
        values = ratings.r.to_numpy(float)
        if params["objective"] == "bpr":
            drawn = np.searchsorted(sides[0 if params["by"] == "v" else 1][0], ratings.w.to_numpy(int))
            order = np.random.default_rng([params["seed"], epoch]).permutation(len(ratings))
            _pairwise(*((p, q, gp, gq, at[0], at[1]) if params["by"] == "u" else (q, p, gq, gp, at[1], at[0])), drawn, order, lr, l2, params["nonnegative"])
        else:
            _rating_steps(params, scale, epoch, at, values, [(p, gp), (q, gq)])
        out = [pd.DataFrame({"kind": kind, "id": ids, "f": list(f), "slow": acc[:, 0], "fast": acc[:, 1]}) for kind, (ids, f, acc) in enumerate(sides)]
        return pd.concat(out)

    return work


def _pairwise(own, other, g_own, g_other, who, good, bad, order, lr, l2, nonnegative):
    """One pass of pairwise steps: the positive's score is raised over that of the drawn one. own: the side that
    ranks (users, or items), other: the side that is ranked."""
    for i in order:
        u, v, w = who[i], good[i], bad[i]
        z = 1 / (1 + np.exp(own[u] @ (other[v] - other[w])))
        grads = -z * (other[v] - other[w]) + l2 * own[u], -z * own[u] + l2 * other[v], z * own[u] + l2 * other[w]
        for x, acc, g in ((own[u], g_own[u], grads[0]), (other[v], g_other[v], grads[1]), (other[w], g_other[w], grads[2])):
            x -= lr / np.sqrt(acc[0]) * g
            if nonnegative:
                np.maximum(x, 0, out=x)
            acc[0] += float((g**2).mean())


def bpr_pairs(ratings: DataFrame, items: int, seed: int = 0, by: str = "u", draws: int = 8, rated: DataFrame | None = None) -> DataFrame:
    """(u, v, w): each positive with a negative drawn from 0 to items - 1, one that its user (or, with
    by="v", its item) has no rating with; rated: all ratings, if `ratings` are not all. The first of `draws` candidates that is none of its positives;
    where all are, the r-th number without a rating, for an r drawn from their count. Only where all
    numbers are rated there is nothing to rank, and no row."""
    own = "v" if by == "u" else "u"
    pairs = ratings.select("u", "v").distinct()
    known = (ratings if rated is None else rated).select(F.col(by).alias("__by"), F.col(own).cast("bigint").alias("__own")).distinct()
    rest, found = pairs, []
    for i in range(draws):  # each round has only those whose candidates were all rated
        drawn = rest.select("u", "v", F.pmod(F.xxhash64(F.lit(seed), "u", "v", F.lit(i)), F.lit(max(1, items))).alias("w"))
        met = drawn.join(known.withColumn("__rated", F.lit(True)), (F.col(by) == F.col("__by")) & (F.col("w") == F.col("__own")), "left")
        met = materialize(met.select("u", "v", "w", F.coalesce("__rated", F.lit(False)).alias("rated")), "draws")
        found.append(met.where("not rated").select("u", "v", "w"))
        rest = met.where("rated").select("u", "v")
        if not rest.take(1):
            break
    first = found[0]
    for more in found[1:]:
        first = first.union(more)
    late = rest.withColumn("__by", F.col(by))
    # a positive with p smaller ones has own - p free numbers below it: one pass over both in this order
    within = known.where(F.col("__own").between(0, items - 1)).join(late.select("__by").distinct(), "__by", "left_semi")
    place = F.row_number().over(Window.partitionBy("__by").orderBy("__own")) - 1
    passed = within.select("__by", (F.col("__own") - place).alias("at"), F.lit(0).alias("ask"), F.lit(None).cast("bigint").alias("u"), F.lit(None).cast("bigint").alias("v"))
    held = within.groupBy("__by").agg(F.count("*").alias("held")).where(F.col("held") < items)
    asks = late.join(held, "__by").select("__by", F.pmod(F.xxhash64(F.lit(seed), "u", "v", F.lit(draws)), F.lit(items) - F.col("held")).alias("at"), F.lit(1).alias("ask"), F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v"))
    so_far = Window.partitionBy("__by").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = passed.union(asks).withColumn("below", F.sum(1 - F.col("ask")).over(so_far)).where("ask = 1")
    kinds = dict(pairs.dtypes)
    return first.union(exact.select(F.col("u").cast(kinds["u"]).alias("u"), F.col("v").cast(kinds["v"]).alias("v"), (F.col("at") + F.col("below")).alias("w")))


def average_models(models: list[DataFrame]) -> DataFrame:
    """Mean factors per id of tables (id, factors); an unknown row counts as zeros."""
    from functools import reduce

    every = reduce(DataFrame.union, [m.select("id", "factors") for m in models]).select("id", F.posexplode("factors").alias("k", "x"))
    means = every.groupBy("id", "k").agg((F.sum(F.nanvl("x", F.lit(0.0))) / len(models)).alias("x"))
    return means.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s")).select("id", F.col("s.x").alias("factors"))


def cross_validate(ratings: DataFrame, folds: int, **params) -> list[float]:
    from .stats import fold

    tagged = ratings.withColumn("__f", fold(F.xxhash64("u", "v"), folds))
    out = []
    for i in range(folds):
        model = NMF(**params).fit(tagged.where(F.col("__f") != i).drop("__f"))
        out.append(evaluate(model.predict(tagged.where(F.col("__f") == i)), ["rmse"]).first().rmse)
    return out
