"""Factorisation: ranks against all pairs, local models and their mean, pairwise fits, long ids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import factorization as mf

RATINGS = "u bigint, v bigint, r double"
SIDE = "id bigint, factors array<double>"


def plain_ranks(ratings, p, q, bias, by):
    """Pair by pair: {id: (n_pos, n_neg, lost)}."""
    own, other, x, y = (p, q, 0, 1) if by == "u" else (q, p, 1, 0)
    every = {r[y] for r in ratings} | set(other)
    pred = lambda a, b: float(sum(s * t for s, t in zip(own[a], other[b]))) if a in own and b in other else bias
    out = {}
    for a in {r[x] for r in ratings}:
        pos = {r[y] for r in ratings if r[x] == a and r[2] > 0}
        if pos and every - pos:
            out[a] = len(pos), len(every - pos), sum(pred(a, b) <= pred(a, c) for b in pos for c in every - pos)
    return out


@pytest.mark.parametrize("by", ["u", "v"])
def test_ranks_equal_all_pairs(spark, by, monkeypatch):
    rng = np.random.default_rng(1)
    ratings = [(int(u), int(v), float(rng.integers(-2, 4))) for u, v in {(u, v) for u, v in rng.integers(0, 30, (250, 2)).tolist()}] + [(99, 7, 1.0), (3, 77, 1.0)]
    p, q = ({i: [float(x) / 2 for x in rng.integers(0, 4, 3)] for i in range(0, n) if i % 7} for n in (30, 33))
    sides = [spark.createDataFrame(list(s.items()), SIDE) for s in (p, q)]
    df = spark.createDataFrame(ratings, RATINGS)
    want = plain_ranks(ratings, p, q, 1.25, by)
    read = lambda: {r.id: (r.n_pos, r.n_neg, r.lost) for r in mf.item_ranks(df, *sides, 1.25, by).collect()}
    assert read() == want and len(want) > 20
    monkeypatch.setattr(mf, "RANK_ROWS", 7)
    monkeypatch.setattr(mf, "RANK_POSITIVES", 2)
    assert read() == want  # many blocks and pieces
    found = mf.rank_summary(mf.item_ranks(df, *sides, 1.25, by)).first()
    assert math.isclose(found.mpr, sum(n / m for _, m, n in want.values()) / sum(w[0] for w in want.values()))
    assert math.isclose(found.auc, np.mean([1 - n / (k * m) for k, m, n in want.values()]))
    assert mf.item_ranks(df.limit(0), *sides, 1.25, by).count() == 0


def test_two_workers_have_the_mean_of_their_models(spark):
    rng = np.random.default_rng(2)
    ratings = spark.createDataFrame([(u, v, float(1 + (u * v) % 5)) for u in range(12) for v in range(9) if rng.random() < 0.7], RATINGS)
    model = mf.NMF(embedding_dim=3, num_epoch=1, workers=2, seed=4).fit(ratings)
    start = mf.NMF(embedding_dim=3, num_epoch=1, workers=2, seed=4)
    _, _, std = mf.rating_stats(ratings).first()
    rows = ratings.withColumn("rank", F.pmod(F.xxhash64(F.lit(4), "u", F.pmod(F.xxhash64("v"), F.lit(1).cast("bigint"))), F.lit(2))).toPandas()
    assert set(rows["rank"]) == {0, 1}
    sides = [start._init(ratings.withColumn("g", F.lit(0)), c, "g").toPandas() for c in ("u", "v")]
    held = [{}, {}]
    for rank in (0, 1):
        mine = rows[rows["rank"] == rank]
        parts = [s[s.id.isin(mine[c])].rename(columns={"id": "a"}).assign(kind=k, b=None, w=None, r=None) for k, (s, c) in enumerate(zip(sides, ("u", "v")))]
        asked = pd.DataFrame({"kind": 2, "a": mine.u, "b": mine.v, "w": None, "r": mine.r / std, "f": None, "slow": None, "fast": None})
        out = mf._tile_worker(dict(start.params), std, 0)(pd.concat([*parts, asked], ignore_index=True))
        for kind, i, f in zip(out.kind, out.id, out.f):
            held[kind].setdefault(i, []).append(f)
    assert any(len(x) == 2 for x in held[1].values()) and all(len(x) == 1 for x in held[0].values())
    for got, want in ((model.p, held[0]), (model.q, held[1])):
        got = {r.id: r.factors for r in got.collect()}
        assert set(got) == set(want)
        assert all(np.allclose(got[i], np.mean(x, axis=0) * math.sqrt(std)) for i, x in want.items())


def test_averaged_fit_learns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p, q = rng.random((30, 3)), rng.random((20, 3))
    ratings = spark.createDataFrame([(u, v, float(p[u] @ q[v] * 4 + 1)) for u in range(30) for v in range(20) if (u + v) % 3], RATINGS)
    monkeypatch.setattr(mf, "TILE_RATINGS", 10)  # every user is dealt to two workers
    model = mf.NMF(embedding_dim=4, num_epoch=4, workers=3).fit(ratings)
    errors = [v for _, split, _, v in model.history if split == "train"]
    assert errors[-1] < errors[0] and model.p.count() == 30 and model.q.count() == 20


@pytest.mark.parametrize("by", ["u", "v"])
def test_pairwise_fit(spark, by):
    """Two tastes: rows rank their own kind first, by drawn negatives that are never rated."""
    rng = np.random.default_rng(5)
    rated = [(u, v, 1.0 if u % 2 == v % 2 else -1.0) for u in range(24) for v in range(18) if rng.random() < (0.6 if u % 2 == v % 2 else 0.1)] + [(23, 17, 1.0)]
    ratings = spark.createDataFrame(rated, RATINGS)
    model = mf.NMF(embedding_dim=4, num_epoch=6, objective="bpr", nonnegative=False, workers=2, by=by, learning_rate=0.3).fit(ratings)
    seen = [v for _, split, name, v in model.history if name == "auc"]
    assert seen[-1] > max(0.75, seen[0] - 0.05)
    n = 18 if by == "u" else 24
    assert (model.q if by == "u" else model.p).count() == n  # each number may be drawn
    drawn = mf.bpr_pairs(ratings.where("r > 0"), n, 3, by, rated=ratings).collect()
    known = {(u, v) for u, v, _ in rated}
    assert len(drawn) == sum(r > 0 for *_, r in rated)
    assert all(((r.u, r.w) if by == "u" else (r.w, r.v)) not in known and 0 <= r.w < n for r in drawn)
    with pytest.raises(ValueError):
        mf.NMF(by="v")


def test_long_ids(spark):
    far = 1 << 40
    ratings = spark.createDataFrame([(far + u, far * 2 + v, float(1 + (u * v) % 5)) for u in range(8) for v in range(6)], RATINGS)
    for workers in (0, 2):
        model = mf.NMF(embedding_dim=2, num_epoch=1, workers=workers).fit(ratings)
        assert {r.id for r in model.p.collect()} == {far + u for u in range(8)}
        assert model.predict(ratings).where("pred is null").count() == 0


def test_equal_factors_meet_the_rows_once(spark, monkeypatch):
    """As many rows are asked for as there are classes of equal factors, not as there are items."""
    df = spark.createDataFrame([(u, v, 1.0) for u in range(6) for v in range(u, 40, 7)], RATINGS)
    p, q = (spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(n)], SIDE) for n in (6, 300))
    plain, seen = mf.materialize, {}

    def kept(table, name, *more):
        seen[name] = table.count()
        return plain(table, name, *more)

    monkeypatch.setattr(mf, "materialize", kept)
    got = {r.id: (r.n_pos, r.n_neg, r.lost) for r in mf.item_ranks(df, p, q, 0.5).collect()}
    sides = [{i: [float(i % 3), 1.0] for i in range(n)} for n in (6, 300)]
    assert got == plain_ranks([tuple(r) for r in df.collect()], *sides, 0.5, "u")
    assert seen["classes"] == 3


@pytest.mark.parametrize("by", ["u", "v"])
def test_negatives_are_the_first_draws(spark, by):
    """The first of the candidates that is not rated, with what is drawn again in proportion to what was rated."""
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (500, 2))})
    df = spark.createDataFrame(pairs, "u int, v int")
    cast = [F.pmod(F.xxhash64(F.lit(9), "u", "v", F.lit(i)), F.lit(40)).alias(f"c{i}") for i in range(8)]
    candidates = {(r.u, r.v): r[2:] for r in df.select("u", "v", *cast).collect()}
    got = {(r.u, r.v): r.w for r in mf.bpr_pairs(df, 40, 9, by).collect()}
    free = lambda p, w: ((p[0], w) if by == "u" else (w, p[1])) not in candidates
    firsts = {p: next((w for w in c if free(p, w)), None) for p, c in candidates.items()}
    assert set(got) == set(pairs) and all(got[p] == w for p, w in firsts.items() if w is not None) and all(free(p, w) for p, w in got.items())
    plan = mf.bpr_pairs(df, 40, 9, by)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(sequence" not in plan and "posexplode" not in plan


def test_factor_rows_go_only_where_ratings_need_them(spark, monkeypatch):
    """Two epochs over many tiles: the factors are those of tiles that hold all rows of their groups, and a row is
    sent once for each sub-step that has ratings of it."""
    rng = np.random.default_rng(5)
    data = [(u, v, float(1 + (u * v) % 5)) for u in range(60) for v in range(40) if rng.random() < 0.1]
    ratings, sent = spark.createDataFrame(data, RATINGS), []
    monkeypatch.setattr(mf, "TILE_RATINGS", 5)
    monkeypatch.setattr(mf, "WORD", 4)
    send = mf.Routed.send
    monkeypatch.setattr(mf.Routed, "send", lambda table, df: (sent.append(table), send(table, df))[1])
    model = mf.NMF(embedding_dim=3, num_epoch=2, seed=4).fit(ratings)
    groups = int(np.ceil(np.sqrt(len(data) / 5)))
    scale = float(np.std([r for *_, r in data]))
    place = {i: g for i, g in spark.range(60).select("id", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(groups)).cast("int")).collect()}
    sides = [model._init(ratings.withColumn("g", F.lit(0)), c, "g").toPandas().assign(kind=k).drop(columns="grp") for k, c in enumerate("uv")]
    state = pd.concat(sides, ignore_index=True)
    for epoch in range(2):
        for s in range(groups):
            done = []
            for tile in range(groups):
                held = state[[place[i] == (tile if k == 0 else (tile + s) % groups) for k, i in zip(state.kind, state.id)]]
                asked = pd.DataFrame([(2, u, v, r / scale) for u, v, r in data if place[u] == tile and place[v] == (tile + s) % groups], columns=["kind", "a", "b", "r"])
                if len(held):
                    done.append(mf._tile_worker(dict(model.params), scale, epoch)(pd.concat([held.rename(columns={"id": "a"}), asked], ignore_index=True)))
            state = pd.concat(done, ignore_index=True)
    for kind, got in ((0, model.p), (1, model.q)):
        got, want = {r.id: r.factors for r in got.collect()}, state[state.kind == kind]
        assert set(got) == set(want.id)
        assert all(np.allclose(got[i], np.array(f) * math.sqrt(scale)) for i, f in zip(want.id, want.f))
    factors = sent[-1].since(0).count()  # all that were ever sent
    steps = {(side, x, (place[v] - place[u]) % groups) for u, v, _ in data for side, x in (("u", u), ("v", v))}
    assert groups > 4 and factors == len({x[:2] for x in steps}) + 2 * len(steps)


@pytest.mark.parametrize("objective", ["l2", "l1", "kl", "logistic", "squared-hinge", "hinge"])
@pytest.mark.parametrize("l1", [0.0, 0.05])
def test_waves_take_the_steps_of_ratings_one_by_one(objective, l1):
    rng, k, scale, lr, l2 = np.random.default_rng(8), 10, 2.0, 0.1, 0.02
    n, sizes = 400, (15, 40)
    ids = [np.arange(m) * 3 for m in sizes]
    factors = [rng.random((m, k)) for m in sizes]
    pairs = pd.DataFrame({"kind": 2, "a": ids[0][np.minimum(rng.geometric(0.2, n) - 1, 14)], "b": ids[1][rng.integers(0, 40, n)], "r": rng.integers(1, 6, n) - 3.0 * ("l" not in objective)})
    rows = pd.concat([pd.DataFrame({"kind": i, "a": ids[i], "f": list(factors[i]), "slow": 1.0, "fast": 1.0}) for i in (0, 1)] + [pairs], ignore_index=True)
    params = dict(mf.NMF(embedding_dim=k, objective=objective, l1_reg=l1, l2_reg=l2 * scale, nonnegative=objective == "l2", learning_rate=lr).params)
    got = mf._tile_worker(params, scale, 1)(rows)
    one = {  # the scalar residuals
        "l2": lambda r, p: r - p,
        "l1": lambda r, p: np.sign(r - p),
        "kl": lambda r, p: r / max(p, 1e-10) - 1,
        "logistic": lambda r, p: r / (1 + np.exp(r * p)) if r > 0 else -1 / (1 + np.exp(-p)),
        "squared-hinge": lambda r, p: (1 if r > 0 else -1) * max(0.0, 1 - (1 if r > 0 else -1) * p),
        "hinge": lambda r, p: (1 if r > 0 else -1) if (1 if r > 0 else -1) * p < 1 else 0.0,
    }[objective]
    pairs = pairs.sort_values(["a", "b", "r"]).reset_index(drop=True)
    accs = [np.ones((m, 2)) for m in sizes]
    for i in np.random.default_rng([0, 1]).permutation(n):
        at = pairs.a[i] // 3, pairs.b[i] // 3
        own = [factors[0][at[0]].copy(), factors[1][at[1]].copy()]
        z = one(pairs.r[i], own[0] @ own[1])
        for side in (0, 1):
            g = -z * own[1 - side] + l2 * own[side]
            for part, slot in ((slice(0, 8), 0), (slice(8, k), 1)):
                eta = lr / np.sqrt(accs[side][at[side], slot])
                step = own[side][part] - eta * g[part]
                if l1:
                    step = np.sign(step) * np.maximum(np.abs(step) - l1 / scale**1.5 * eta, 0)
                factors[side][at[side], part] = np.maximum(step, 0) if objective == "l2" else step
                accs[side][at[side], slot] += (g[part] ** 2).mean()
    for side in (0, 1):
        out = got[got.kind == side]
        assert list(out.id) == list(ids[side]) and np.allclose(np.array(out.f.tolist()), factors[side], rtol=1e-9, atol=1e-9)
        assert np.allclose(out[["slow", "fast"]].to_numpy(), accs[side], rtol=1e-9)


def test_waves_share_no_row_and_are_few():
    rng = np.random.default_rng(9)
    u, v = rng.integers(0, 3000, 5000), rng.integers(0, 2000, 5000)
    waves = mf._waves(u, v)
    assert sorted(np.concatenate(waves)) == list(range(5000)) and len(waves) < 60
    assert all(len(set(u[w])) == len(w) == len(set(v[w])) for w in waves)
    assert mf._waves(u[:0], v[:0]) == [] or not sum(map(len, mf._waves(u[:0], v[:0])))
