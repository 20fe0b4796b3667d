"""Tree learners against plain versions: quantile summaries, sparse bins, growth, scoring, validation."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import stats, trees
from tessera.sources.storage import materialize

ROWS = "row_id bigint, label double, indices array<int>, values array<double>"


def sparse(x, labels):
    """Rows of a matrix in which zeros are absent."""
    return [(i, float(y), [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[np.flatnonzero(r)]]) for i, (r, y) in enumerate(zip(x, labels))]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(600, 5)), 2) * (rng.random((600, 5)) < 0.6)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=600) > 0).astype(float)
    return x, y, spark.createDataFrame(sparse(x, y), ROWS).repartition(3).cache()


def plain_tree(bins, g, h, edges, depth, least, lam=0.0):
    """Level by level with whole histograms: {node: (fid, bin)} and {leaf: weight}."""
    nodes, leaves, todo = {}, {}, [(0, np.arange(len(g)))]
    while todo:
        node, rows = todo.pop(0)
        best = None
        if len(rows) > least and node < 2**depth - 1:
            for f in range(bins.shape[1]):
                for b in range(len(edges[f]) - 1):
                    left = rows[bins[rows, f] <= b]
                    right = rows[bins[rows, f] > b]
                    if len(left) and len(right):
                        term = lambda r: g[r].sum() ** 2 / (h[r].sum() + lam)
                        gain = term(left) + term(right) - term(rows) - lam
                        if gain > 0 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, b, left, right)
        if best is None:
            leaves[node] = -g[rows].sum() / (h[rows].sum() + lam)
        else:
            nodes[node] = best[1:3]
            todo += [(2 * node + 1, best[3]), (2 * node + 2, best[4])]
    return nodes, leaves


def test_growth_equals_plain_version_and_reads_half(data):
    x, y, df = data
    model = trees.GBDT(max_depth=3, num_round=1, min_node_ins=20, exact_splits=True, reg_lambda=0.5).fit(df)
    edges = {r.fid: r.edges for r in model.splits.collect()}
    bins = np.stack([np.maximum(np.searchsorted(edges[f], x[:, f], side="right") - 1, 0) for f in range(5)], axis=1)
    p = 1 / (1 + np.exp(-model.start[0]))
    nodes, leaves = plain_tree(bins, p - y, np.full(len(y), p * (1 - p)), edges, 3, 20, 0.5)
    tree = model.trees[0]
    assert {n: (f, b) for n, (f, _, b, _) in tree.nodes.items()} == nodes and len(nodes) > 3
    assert set(tree.leaves) == set(leaves) and all(math.isclose(tree.leaves[n][0], w, rel_tol=1e-9) for n, w in leaves.items())
    assert model.scanned[0] == len(y) and len(model.scanned) == 3 and all(n <= len(y) / 2 for n in model.scanned[1:])


def test_binning_by_join_gives_the_same_trees(data, monkeypatch):
    _, _, df = data
    fit = lambda: trees.GBDT(max_depth=2, num_round=1, min_node_ins=20).fit(df).trees
    want = fit()
    monkeypatch.setattr(stats, "FEW_FEATURES", 0)
    got = fit()
    assert [t.nodes for t in got] == [t.nodes for t in want]
    assert all(np.allclose(got[0].leaves[n], w) for n, w in want[0].leaves.items())


def test_a_million_features(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        fids = sorted({int(f) for f in rng.integers(0, 1_000_000, 20)} | ({777_777} if i % 2 else set()))
        rows.append((i, float(i % 2), fids, [1.0] * len(fids)))
    df = spark.createDataFrame(rows, ROWS)
    model = trees.GBDT(max_depth=2, num_round=1, min_node_ins=20, learning_rate=1.0).fit(df)
    assert model.trees[0].nodes[0][0] == 777_777
    assert all((r.score > 0) == bool(r.row_id % 2) for r in model.predict_score(df).collect())


@pytest.mark.parametrize("leafwise", [False, True])
def test_node_budget(data, leafwise):
    """Growth goes on while two more nodes are fewer than the budget."""
    _, _, df = data
    sizes = [len(trees.GBDT(max_depth=3, max_node_num=m, num_round=1, min_node_ins=20, leafwise=leafwise).fit(df).trees[0].ids()) for m in (3, 5, 6)]
    assert sizes == [1, 3, 5]


@pytest.mark.parametrize("cls", [trees.GBDT, trees.RandomBoostedForest])
def test_validation_on_carried_predictions(data, cls):
    _, _, df = data
    valid = df.where("row_id % 3 = 0")
    model = cls(max_depth=2, num_round=3, min_node_ins=20, ins_sp_ratio=0.8, feat_sp_ratio=0.9).fit(df.where("row_id % 3 <> 0"), valid)
    names = ["log-loss", "precision"]
    assert [(t, s, k) for t, s, k, _ in model.history] == [(t, s, k) for t in range(3) for s in ("train", "valid") for k in ("log_loss", "precision")]
    want = model.evaluate(valid, names).first().asDict()
    assert all(math.isclose(v, want[k], abs_tol=1e-9) for t, s, k, v in model.history if t == 2 and s == "valid")
    want = model.evaluate(df.where("row_id % 3 <> 0"), names).first().asDict()
    assert all(math.isclose(v, want[k], abs_tol=1e-9) for t, s, k, v in model.history if t == 2 and s == "train")


def walked(tree, row, k):
    node = 0
    while node in tree.nodes:
        fid, threshold, _, _ = tree.nodes[node]
        v = row.get(fid, 0.0)
        node = 2 * node + (2 if (0.0 if v != v else v) >= threshold else 1)
    return tree.leaves[node][k]


def test_scoring_equals_walking_tree_by_tree(spark):
    rng = np.random.default_rng(13)
    forest = []
    for _ in range(100):
        nodes = {n: (int(rng.integers(0, 40)), float(rng.normal()), 0, 0.0) for n in range(255) if rng.random() < 0.95 or n < 3}
        nodes = {n: v for n, v in nodes.items() if n == 0 or (n - 1) // 2 in nodes}
        while True:
            keep = {n: v for n, v in nodes.items() if n == 0 or (n - 1) // 2 in nodes}
            if len(keep) == len(nodes):
                break
            nodes = keep
        tree = trees.Tree(nodes)
        tree.leaves = {n: [float(x) for x in rng.normal(size=3)] for n in tree.ids() if n not in nodes}
        forest.append(tree)
    rows = [(i, 0.0, [int(j) for j in np.flatnonzero(rng.random(45) < 0.5)], []) for i in range(60)]
    rows = [(i, y, js, [float(v) for v in rng.normal(size=len(js))]) for i, y, js, _ in rows] + [(60, 0.0, [0, 3], [float("nan"), float("inf")]), (61, 0.0, [], []), (62, None, None, None)]
    df, at = spark.createDataFrame(rows, ROWS), {i: dict(zip(js or [], vs or [])) for i, _, js, vs in rows}
    three = trees.GBDT(num_label=3)
    three.start, three.trees = [0.1, 0.2, 0.3], forest
    for r in three.predict_score(df).collect():
        assert np.allclose(r.score, [s + 0.1 * sum(walked(t, at[r.row_id], k) for t in forest) for k, s in enumerate(three.start)])
    one = trees.GBDT(num_label=3, multi_tree=True)
    one.start, one.trees = [0.0] * 3, forest[:30]
    for r in one.predict_score(df).collect():
        assert np.allclose(r.score, [0.1 * sum(walked(t, at[r.row_id], 0) for t in forest[k:30:3]) for k in range(3)])
    votes = trees.RandomBoostedForest(num_label=3)
    votes.start, votes.trees = [0.0] * 3, forest
    for r in votes.predict_score(df).collect():
        picks = [int(np.argmax([walked(t, at[r.row_id], k) for k in range(3)])) for t in forest]
        assert np.allclose(r.score, [picks.count(k) / 100 for k in range(3)])
    # and as nested conditions
    get = lambda fid: F.element_at(F.map_from_arrays("indices", "values"), F.lit(fid))
    small = trees.Tree({n: v for n, v in forest[0].nodes.items() if n < 15})
    small.leaves = {n: [float(n)] for n in small.ids() if n not in small.nodes}
    two = trees.GBDT(learning_rate=1.0)
    two.start, two.trees = [0.0], [small]
    nested = df.where("indices is not null").select("row_id", small.value(get, 0).alias("score"))
    assert sorted(map(tuple, nested.collect())) == sorted(tuple(r) for r in two.predict_score(df).collect() if r.row_id != 62)
    none = trees.GBDT()
    none.start, none.trees = [0.25], []
    assert {r.score for r in none.predict_score(df).collect()} == {0.25}


def test_full_second_derivatives(spark):
    rows = [(i, float(i % 3), [0, 1], [float(i % 3) + 0.01 * (i % 5), 1.0]) for i in range(150)]
    df = spark.createDataFrame(rows, ROWS)
    model = trees.GBDT(num_label=3, max_depth=2, num_round=2, learning_rate=0.5, min_node_ins=5, reg_lambda=0.1, full_hessian=True).fit(df)
    assert model.evaluate(df, ["precision"]).first()[0] > 0.9
    p = np.exp(model.start) / np.exp(model.start).sum()
    hess = np.diag(p * (1 - p)) - (np.outer(p, p) - np.diag(p * p))
    tree = model.trees[0]
    n, y = tree.nodes, np.array([r[1] for r in rows], int)
    reached = {i: next(iter([node for node in [_leaf(tree, dict(zip(r[2], r[3])))]])) for i, r in enumerate(rows)}
    for leaf, w in tree.leaves.items():
        here = [i for i in reached if reached[i] == leaf]
        g = sum((p - np.eye(3)[y[i]] for i in here), np.zeros(3))
        assert n and np.allclose(w, -np.linalg.solve(len(here) * hess + 0.1 * np.eye(3), g))
    with pytest.raises(ValueError):
        trees.GBDT(full_hessian=True)


def _leaf(tree, row):
    node = 0
    while node in tree.nodes:
        node = 2 * node + (2 if row.get(tree.nodes[node][0], 0.0) >= tree.nodes[node][1] else 1)
    return node


def test_packed_systems(spark):
    rng = np.random.default_rng(14)
    a = rng.normal(size=(20, 4, 4))
    whole, rhs = a @ a.transpose(0, 2, 1) + np.eye(4), rng.normal(size=(20, 4))
    packed = np.stack([whole[:, i, j] for i in range(4) for j in range(i + 1)], axis=1)
    assert np.allclose(V.solve_packed(packed, rhs), np.linalg.solve(whole, rhs[..., None])[..., 0])
    assert np.isnan(V.solve_packed(np.array([[1.0, 2.0, 1.0]]), np.ones((1, 2)))).all()  # not positive definite
    assert np.allclose(V.solve_spd([[2.0, 1.0], [1.0, 3.0]], [1.0, 2.0]), [0.2, 0.6])
    df = spark.createDataFrame([([2.0, 1.0, 3.0], [1.0, 2.0])], "m array<double>, r array<double>")
    assert np.allclose(V.solved(df, "m", "r").first().x, [0.2, 0.6])
    assert V.solved(df.limit(0), "m", "r").count() == 0


def test_summaries_merge_and_lead_to_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(15)
    rows = [(0, float(v)) for v in rng.normal(size=30_000)] + [(1, float(v)) for v in rng.integers(0, 40, 5_000)] + [(2, 3.5), (3, None), (3, float("nan")), (1, float("nan"))]
    long = spark.createDataFrame(rows, "fid int, value double").repartition(4).cache()
    fractions = [i / 10 for i in range(11)]
    parts = [stats.quantile_summary(long.where(F.pmod(F.xxhash64("value"), F.lit(3)) == i), 200) for i in range(3)]
    merged = stats.merge_summaries(parts[0].union(parts[1]).union(parts[2])).cache()
    values = {f: np.sort([v for g, v in rows if g == f and v == v and v is not None]) for f in range(3)}
    assert {r.fid: (r.n, r.low, r.high) for r in merged.collect()} == {f: (len(v), v[0], v[-1]) for f, v in values.items()}
    for r in stats.summary_quantiles(merged, fractions).collect():
        v = values[r.fid]
        for f, q in zip(fractions, r.q):
            low, high = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert max(low - f, f - high) <= 4 * stats.rank_error(200)
    exact = {r.fid: r.q for r in stats.exact_quantiles(long, merged, fractions, 200).collect()}
    assert all(np.allclose(exact[f], np.quantile(v, fractions)) for f, v in values.items()) and len(exact) == 3
    monkeypatch.setattr(stats, "rank_error", lambda size: 0.0)  # brackets that miss
    again = {r.fid: r.q for r in stats.exact_quantiles(long, merged, fractions, 200).collect()}
    assert all(np.allclose(again[f], exact[f]) for f in exact)
    rough = {r.fid: r.edges for r in stats.candidate_splits(long, 10, exact=False).collect()}
    assert set(rough) == {0, 1, 2} and rough[2] == [3.0, 3.5] and np.allclose(rough[0], exact[0][:10], atol=0.1)


def test_few_and_many_values(spark):
    """Features around the number of values up to which all are edges."""
    rows = [(k, float(v)) for k in range(1, 31) for v in range(1, k + 1) for _ in range(3)]
    got = {r.fid: r.edges for r in stats.candidate_splits(spark.createDataFrame(rows, "fid int, value double"), 10).collect()}
    assert got[1] == [0.5, 1.0] and all(got[k] == [float(v) for v in range(1, k + 1)] for k in range(2, 11))
    assert all(np.allclose(got[k], np.unique(np.quantile(np.repeat(np.arange(1, k + 1), 3), [i / 10 for i in range(10)]))) for k in range(11, 31))


def test_values_meet_their_edges_where_they_are(spark):
    """No shuffle by feature and no broadcast of the values, whatever sizes are estimated."""
    long = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("fid"), (F.col("id") % 10).cast("double").alias("value"))
    splits = spark.createDataFrame([(0, [0.0, 3.0, 6.0], 0), (1, [0.0, 5.0], 0)], "fid int, edges array<double>, default_bin int")
    binned = stats.bin_values(long, splits)
    plan = binned._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "hashpartitioning" not in plan
    got = {(r.fid, r.value, r.bin) for r in binned.collect()}
    assert got == {(int(v) % 2, float(v), sum(v >= e for e in ([0, 3, 6], [0, 5])[int(v) % 2]) - 1) for v in range(10)}


def test_exact_quantiles_count_the_values_once(spark, monkeypatch):
    """Values outside of the brackets are not listed for each bracket: one table holds their counts."""
    tables = {}
    monkeypatch.setattr(stats, "materialize", lambda df, name: tables.setdefault(name, materialize(df, name)))
    long = spark.range(20000).select(F.lit(0).alias("fid"), ((F.col("id") * 7919) % 20000).cast("double").alias("value"))
    for fractions in ([i / 10 for i in range(10)], [i / 20 for i in range(20)]):
        tables.clear()
        got = stats.exact_quantiles(long, stats.quantile_summary(long), fractions).first().q
        assert np.allclose(got, [f * 19999 for f in fractions])
        assert tables["between"].agg(F.sum("c")).first()[0] == 20000 and tables["between"].count() < 8000


def test_values_meet_brackets_in_a_broadcast_whatever_is_estimated(spark, sf_dir):
    from tessera.plans.catalogue import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["quantile_summary"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "strategy=broadcast" in plan


def test_small_trees_are_walked_by_conditions_as_large_ones_by_a_table(spark, monkeypatch):
    tree = trees.Tree({0: (3, 1.0, 1, 0.0), 1: (5, 1.0, 0, 0.0), 4: (3, 1.0, 0, 0.0)}, {}, {0: 0, 1: 2, 4: 1})
    rows = spark.createDataFrame([([], []), ([3], [2]), ([3, 5], [1, 0]), ([5], [0]), ([3, 5], [0, 1])], "fids array<int>, bins array<int>")
    by_conditions = tree.walk()
    monkeypatch.setattr(trees, "FEW_NODES", 0)
    both = rows.select(by_conditions.alias("a"), tree.walk().alias("b")).collect()
    assert "transform" not in str(by_conditions) and [r.a for r in both] == [r.b for r in both]
    assert "aggregate" not in str(by_conditions)


def test_rows_with_odd_entries_are_read_binned_and_scored(spark):
    from tessera.sources import readers

    nan, dense = float("nan"), "row_id bigint, features array<double>"
    got = {r.row_id: (r.indices, r["values"]) for r in readers.from_dense(spark.createDataFrame([(0, [1.0, nan, None, 2.0]), (1, []), (2, None), (3, [0.0])], dense)).collect()}
    assert got == {0: ([0, 3], [1.0, 2.0]), 1: ([], []), 2: (None, None), 3: ([0], [0.0])}
    rows = spark.createDataFrame([(0, [0, 1], [1.0, 5.0]), (1, [1, 0], [nan, 9.0]), (2, [0, 1, 7], [None, 2.0]), (3, [], []), (4, [7], [1.0])], "row_id bigint, indices array<int>, values array<double>")
    splits = spark.createDataFrame([(0, [0.0, 1.0, 3.0], 0), (1, [-1.0, 0.0, 2.0], 1)], "fid int, edges array<double>, default_bin int")
    binned = {r.row_id: (r.fids, r.bins) for r in stats.bin_rows(rows, splits, ["row_id"]).collect()}
    assert binned == {0: ([0, 1], [1, 2]), 1: ([0], [2]), 2: ([1], [2]), 3: ([], []), 4: ([], [])}
    tree = trees.Tree({0: (1, 2.0, 1, 0.0)}, {1: [-1.0], 2: [1.0]})
    scores = {r.row_id: r.score for r in trees.score_rows(rows, [tree], 1, lambda w: w.sum(axis=1)).collect()}
    assert scores == {0: 1.0, 1: -1.0, 2: 1.0, 3: -1.0, 4: -1.0}


def test_many_features_are_counted_and_few_have_sketches(spark, monkeypatch):
    rng, tables = np.random.default_rng(4), {}
    monkeypatch.setattr(stats, "materialize", lambda df, name: tables.setdefault(name, materialize(df, name)))
    rows = [(f, float(v)) for f in range(300) for v in rng.integers(1, 4 + f % 20, 30)] + [(300, float(v)) for v in rng.normal(size=500)] + [(301, None), (5, float("nan"))]
    got = {r.fid: r.edges for r in stats.candidate_splits(spark.createDataFrame(rows, "fid int, value double"), 10, size=100).collect()}
    assert set(got) == set(range(301)) and {r.fid for r in tables["summary"].collect()} == {300}
    for f, edges in got.items():
        values = np.array([v for g, v in rows if g == f and v == v])
        kinds = np.unique(values)
        assert np.allclose(edges, kinds if len(kinds) <= 10 else np.unique(np.quantile(values, [i / 10 for i in range(10)])))
