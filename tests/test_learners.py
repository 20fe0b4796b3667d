"""Learners: closed forms, invariants, round trips, independence of partitions."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bayes, factorization, linear, neighbors, stats, topics, trees
from tessera.plans import catalogue
from tessera.sources import readers
from tessera.sources.storage import shared_dir


@pytest.fixture(scope="module")
def toy(spark):
    """Two classes that the first feature splits; some entries are absent."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        y = i % 2
        x = [(2.0 if y else -2.0) + rng.normal(), rng.normal(), 0.0 if i % 3 else rng.normal()]
        keep = [j for j in range(3) if x[j] != 0]
        rows.append((i, float(y), keep, [float(x[j]) for j in keep]))
    return spark.createDataFrame(rows, "row_id bigint, label double, indices array<int>, values array<double>").cache()


def signed(df):
    return df.withColumn("label", 2 * F.col("label") - 1)


def share_right(model, data, negative=0.0):
    scored = model.predict_score(data).join(data.select("row_id", "label"), "row_id")
    return scored.agg(F.avg(((F.col("score") > 0) == (F.col("label") > negative)).cast("double"))).first()[0]


def test_linear_regression_step_is_closed_form(toy):
    model = linear.LinearRegression(num_epoch=2, batch_size=10**6, learning_rate=0.05).fit(toy)
    rows = sorted(toy.collect())
    x, y = np.zeros((len(rows), 3)), np.array([r.label for r in rows])
    for i, r in enumerate(rows):
        x[i, r.indices] = r["values"]
    w, b = np.zeros(3), 0.0
    for _ in range(2):
        g = np.clip(x @ w + b, -20, 20) - y
        w, b = w - 0.05 * x.T @ g / len(y), b - 0.05 * g.mean()
    assert np.allclose(model.weights, w) and math.isclose(model.bias, b)


@pytest.mark.parametrize("cls", [linear.LogisticRegression, linear.SupportVectorMachine, linear.FactorizationMachine])
def test_linear_learners_learn_and_round_trip(spark, toy, cls):
    data = signed(toy)
    extra = {"embedding_dim": 3} if cls is linear.FactorizationMachine else {}
    model = cls(num_epoch=3, batch_size=200, learning_rate=0.5, **extra).fit(data, data)
    seen = [v for _, split, _, v in model.history if split == "train"]
    assert seen[-1] < seen[0] and share_right(model, data) > 0.9
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    again = cls.load_model(spark, path)
    a, b = ({r.row_id: r.score for r in m.predict_score(data).collect()} for m in (model, again))
    assert a == b
    proba = model.predict_proba(data).agg(F.min("proba"), F.max("proba")).first()
    assert 0 <= proba[0] <= proba[1] <= 1


def test_long_weights_are_joined(toy):
    n = 1 << 17
    w = np.zeros(n)
    w[:3] = [1.0, -2.0, 3.0]
    short, long = (linear.scores(toy, x, 0.5).select("row_id", "score").orderBy("row_id").collect() for x in (w[:3], w))
    assert all(math.isclose(a.score, b.score, abs_tol=1e-12) for a, b in zip(short, long))


def test_batches_are_rows(spark, toy):
    sparse_ids = toy.withColumn("row_id", F.col("row_id") * 1000 + 7)
    model = linear.LinearRegression(num_epoch=1, batch_size=64, learning_rate=0.05)
    rows, n, dim = model.prepare(sparse_ids)
    assert (n, dim) == (7, 3)
    assert [b.count() for b in model.batches(rows, n)] == [64] * 6 + [16]
    model.fit(sparse_ids)
    x, y = np.zeros((400, 3)), np.array([r.label for r in sorted(toy.collect())])
    for i, r in enumerate(sorted(toy.collect())):
        x[i, r.indices] = r["values"]
    w, b = np.zeros(3), 0.0
    for lo in range(0, 400, 64):
        part, goal = x[lo : lo + 64], y[lo : lo + 64]
        g = np.clip(part @ w + b, -20, 20) - goal
        w, b = w - 0.05 * part.T @ g / len(goal), b - 0.05 * g.mean()
    assert np.allclose(model.weights, w) and math.isclose(model.bias, b)


def test_factorisation_machine_of_many_features(spark):
    far = 70_000
    rows = [(i, float(2 * (i % 2) - 1), [i % 2, far], [1.0, 0.5]) for i in range(60)]
    data = spark.createDataFrame(rows, "row_id bigint, label double, indices array<int>, values array<double>")
    model = linear.FactorizationMachine(num_epoch=1, batch_size=60, learning_rate=0.5, embedding_dim=2).fit(data)
    w, v = model.weights[0], model.weights[1:]
    for r in model.predict_score(data).collect():
        k = r.row_id % 2
        assert math.isclose(r.score, w[k] + 0.5 * w[far] + 0.5 * float(v[:, k] @ v[:, far]), abs_tol=1e-9)


def test_naive_bayes(spark, toy):
    model = bayes.NaiveBayes(num_label=2).fit(toy)
    scored = model.predict_score(toy).join(toy.select("row_id", "label"), "row_id")
    right = scored.agg(F.avg((F.when(F.get("score", F.lit(1)) > F.get("score", F.lit(0)), 1).otherwise(0) == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9 and len(scored.first().score) == 2
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    assert bayes.NaiveBayes.load_model(spark, path).predict_score(toy).exceptAll(model.predict_score(toy)).count() == 0
    bare = spark.createDataFrame([(1, 0.0, [], [])], toy.schema)  # a row without entries scores its priors
    assert np.allclose(model.predict_score(bare).first().score, [0.5, 0.5])


def test_labels_are_checked(spark, toy):
    with pytest.raises(Exception, match="bad label"):
        stats.check_labels(toy.withColumn("label", F.lit(7.0)), 2).collect()
    with pytest.raises(ValueError, match="bad label"):
        stats.check_labels(toy.withColumn("label", F.col("row_id") % 3 - 1.0))
    with pytest.raises(ValueError):
        linear.LogisticRegression(num_epoch=0)
    with pytest.raises(ValueError):
        trees.RandomBoostedForest(multi_tree=True)


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    some = {r.row_id for r in stats.sample_rows(df, 0.3001, 5).collect()}
    assert len(some) == 301 and some == {r.row_id for r in stats.sample_rows(df.repartition(7), 0.3001, 5).collect()}
    assert stats.sample_rows(df, 1.0, 5).count() == 1000 and stats.sample_rows(df.limit(0), 0.5, 5).count() == 0


def test_knn_blocks_and_ties(spark):
    points = spark.createDataFrame([(i, i % 2, [float(i // 2), 0.0]) for i in range(40)], "row_id bigint, label int, features array<double>")
    one = neighbors.nearest(points, points, 3).select("query", "neighbour", "rank").collect()
    some = neighbors.nearest(points, points, 3, block_bytes=200).select("query", "neighbour", "rank").collect()
    assert sorted(one) == sorted(some) and len(one) == 120
    assert {r.neighbour for r in one if r.query == 4} == {4, 5, 2}
    with pytest.raises(ValueError):
        neighbors.nearest(points, points, 40)
    score = neighbors.KNN(2, 3).predict_score(points, points).first().score
    assert math.isclose(sum(score), 1.0)


def test_candidate_splits_edge_cases(spark):
    cases = {0: [1.0] * 5, 1: [0.0] * 5, 2: [-3.0, -2.0, -1.0], 3: [0.0, 1.0, 2.0], 4: [float(x) for x in range(50)], 5: [float("nan"), -1.0, 0.0]}
    long = spark.createDataFrame([(f, x) for f, xs in cases.items() for x in xs], "fid int, value double")
    got = {r.fid: (r.edges, r.default_bin) for r in stats.candidate_splits(long, 10).collect()}
    assert got[0] == ([0.5, 1.0], 0) and got[1] == ([-0.5, 0.0, 0.5], 1) and got[2] == ([-3.0, -2.0, -1.0], 2)
    assert got[3] == ([-0.5, 0.0, 1.0, 2.0], 1) and len(got[4][0]) == 11 and got[5][0] == [-1.0, 0.0, 0.5]


@pytest.mark.parametrize("options", [{}, {"leafwise": True, "max_node_num": 7}, {"is_regression": True}, {"ins_sp_ratio": 0.7, "reg_lambda": 1.0, "reg_alpha": 0.1, "max_leaf_weight": 1.0}])
def test_gbdt(spark, toy, options):
    model = trees.GBDT(max_depth=3, num_round=2, learning_rate=0.5, min_node_ins=10, **options).fit(toy)
    score = model.predict_score(toy).join(toy.select("row_id", "label"), "row_id")
    cut = 0.5 if options.get("is_regression") else 0.0
    assert score.agg(F.avg(((F.col("score") > cut) == (F.col("label") > 0)).cast("double"))).first()[0] > 0.85
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    again = trees.GBDT.load_model(spark, path)
    assert again.predict_score(toy).exceptAll(model.predict_score(toy)).count() == 0


def test_gbdt_scores_training_rows_as_the_fit_placed_them(toy):
    model = trees.GBDT(max_depth=2, num_round=1, learning_rate=1.0, min_node_ins=10).fit(toy)
    tree = model.trees[0]
    assert tree.nodes and set(tree.leaves) == {c for n in tree.nodes for c in (2 * n + 1, 2 * n + 2)} - set(tree.nodes)
    values = {round(w[0] + model.start[0], 9) for w in tree.leaves.values()}
    assert {round(r.score, 9) for r in model.predict_score(toy).collect()} <= values


@pytest.mark.parametrize("multi_tree", [False, True])
def test_gbdt_multi_class(spark, multi_tree):
    rows = [(i, float(i % 3), [0, 1], [float(i % 3) + 0.01 * (i % 5), 1.0]) for i in range(150)]
    data = spark.createDataFrame(rows, "row_id bigint, label double, indices array<int>, values array<double>")
    model = trees.GBDT(num_label=3, max_depth=2, num_round=2, learning_rate=0.5, min_node_ins=5, multi_tree=multi_tree).fit(data)
    assert model.evaluate(data, ["precision"]).first()[0] > 0.9  # one bin holds two classes


def test_forest(toy):
    model = trees.RandomBoostedForest(max_depth=2, num_round=3, min_node_ins=5, ins_sp_ratio=0.8, feat_sp_ratio=1.0).fit(toy)
    assert share_right(model, toy) > 0.9
    assert {round(abs(r.score) * 3) for r in model.predict_score(toy).collect()} <= {1, 3}


def test_nmf(spark):
    rng = np.random.default_rng(1)
    p, q = rng.random((30, 3)), rng.random((20, 3))
    ratings = spark.createDataFrame([(u, v, float(p[u] @ q[v] * 4 + 1)) for u in range(30) for v in range(20) if (u + v) % 3], "u int, v int, r double")
    model = factorization.NMF(embedding_dim=4, num_epoch=3).fit(ratings)
    errors = [v for _, split, _, v in model.history if split == "train"]
    assert errors[-1] < errors[0]
    assert min(min(r.factors) for r in model.p.collect()) >= 0
    unseen = model.predict(spark.createDataFrame([(99, 1, 0.0)], ratings.schema)).first()
    assert math.isclose(unseen.pred, model.bias)
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    assert factorization.NMF.load_model(spark, path).predict(ratings).exceptAll(model.predict(ratings)).count() == 0


def test_nmf_tiles(spark, monkeypatch):
    monkeypatch.setattr(factorization, "TILE_RATINGS", 40)
    ratings = spark.createDataFrame([(u, v, float(1 + (u * v) % 5)) for u in range(20) for v in range(15)], "u int, v int, r double")
    model = factorization.NMF(embedding_dim=2, num_epoch=2).fit(ratings)
    assert model.p.count() == 20 and model.q.count() == 15


def test_lda(spark):
    corpus = spark.createDataFrame([(d, p, (p % 4) + 4 * (d % 2)) for d in range(20) for p in range(30 if d else 700)], "doc_id bigint, pos int, word_id int")
    model = topics.LDA(num_words=8, num_topics=2, num_iters=3, alpha=0.5, beta=0.01).fit(corpus)
    assert model.counts.sum() == corpus.count() and (model.counts >= 0).all()
    seen = [v for *_, v in model.history]
    assert seen[-1] >= seen[0]
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    again = topics.LDA.load_model(spark, path)
    assert (again.counts == model.counts).all() and again.predict(corpus).count() == corpus.count()


def test_lda_joins_a_large_word_table(spark, monkeypatch):
    corpus = spark.createDataFrame([(d, p, (p * d) % 11 * 10) for d in range(20) for p in range(30 if d else 700)], "doc_id bigint, pos int, word_id int")
    fit = lambda: topics.LDA(num_words=101, num_topics=3, num_iters=2, alpha=0.5).fit(corpus)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "pos", "word_id", "topic").collect()))
    model = fit()
    want, guess = rows(model.tokens), rows(model.predict(corpus))
    monkeypatch.setattr(topics, "MAX_COUNTS", 100)
    model = fit()
    assert model.counts is None and rows(model.tokens) == want and rows(model.predict(corpus)) == guess
    path = shared_dir(spark, "model")
    model.save_model(spark, path)
    assert rows(topics.LDA.load_model(spark, path).predict(corpus)) == guess


def test_lda_query_runs_on_words(spark, sf_dir):
    from tessera.plans.catalogue import QUERIES, tokens

    got = QUERIES["lda_fit"](spark, sf_dir).toPandas()
    want = {r.word: r["count"] for r in tokens(spark, sf_dir).groupBy("word").count().collect()}
    assert got.groupby("word").n.sum().to_dict() == want
    assert dict(zip(got.word, got.word_id)) == {w: i for i, w in enumerate(sorted(want))}
    assert got.topic.between(0, 4).all() and not got.duplicated(["word", "topic"]).any()


def test_lda_query_takes_all_iterations(spark, sf_dir, monkeypatch):
    """The estimator's own number of iterations; tables of turns that have passed are gone."""
    from tessera.plans.catalogue import QUERIES

    seen, fit = [], topics.LDA.fit

    def shortly(model, corpus):
        seen.append(model.params["num_iters"])
        model.params["num_iters"] = 3
        found = fit(model, corpus)
        seen.append(sorted(os.listdir(model.turns.path.removeprefix("file://"))))
        assert len(model.history) == 3 and math.isclose(model.history[-1][-1], model.log_likelihood(model.tokens), rel_tol=1e-9)
        return found

    monkeypatch.setattr(topics.LDA, "fit", shortly)
    assert QUERIES["lda_fit"](spark, sf_dir).count() > 0
    assert seen == [topics.LDA(num_words=1).params["num_iters"], ["2"]] and seen[0] == 100


def test_corpus_index_of_words(spark, sf_dir):
    from tessera.plans.catalogue import tokens

    found = readers.corpus_index(tokens(spark, sf_dir).select(F.col("word").alias("word_id")))
    assert "SinglePartition" not in found._jdf.queryExecution().toString()
    at = 0
    for r in sorted(found.collect()):
        assert r.first == at, r
        at += r.n
    assert at == tokens(spark, sf_dir).count()
    assert readers.corpus_index(spark.createDataFrame([], "word_id int")).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.svm").write_text("# note\n\n1 1:0.5 3:2\n-1 2:1e-1\n skip 1:1\n+1\n")
    rows = readers.read_libsvm(spark, f"file://{tmp_path}/a.svm").orderBy("row_id").collect()
    assert [(r.label, r.indices, r["values"]) for r in rows] == [(1.0, [0, 2], [0.5, 2.0]), (-1.0, [1], [0.1]), (1.0, [], [])]
    (tmp_path / "bad.svm").write_text("1 nonsense\n")
    with pytest.raises(Exception, match="cannot parse"):
        readers.read_libsvm(spark, f"file://{tmp_path}/bad.svm").collect()
    (tmp_path / "a.csv").write_text("3,1.5,,2\n1,0,1,2\n")
    rows = readers.read_csv(spark, f"file://{tmp_path}/a.csv", neg_y=True).orderBy("row_id").collect()
    assert rows[0].label == -1.0 and math.isnan(rows[0].features[1]) and rows[1].label == 1.0
    (tmp_path / "r.txt").write_text("1 2 3.5\n4 5 1\n")
    assert readers.read_coo(spark, f"file://{tmp_path}/r.txt").count() == 2
    (tmp_path / "c.txt").write_text("0\t5 6 5\n1\t7\n")
    assert [tuple(r) for r in readers.read_corpus(spark, f"file://{tmp_path}/c.txt").orderBy("doc_id", "pos").collect()] == [(0, 0, 5), (0, 1, 6), (0, 2, 5), (1, 0, 7)]
    assert readers.from_csr(spark, [0, 2, 1], [0, 2, 3], [1, 2, 3], [0, 1]).count() == 2
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x", "xml")
    long = readers.to_long(readers.from_csr(spark, [0, 2, 1], [0, 2, 3], [1, 2, 3]))
    assert readers.to_sparse_rows(long).count() == 2


def test_partitions_do_not_matter(spark, sf_dir):
    long = catalogue.li_long(spark, sf_dir)
    counts = catalogue.li(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    results = []
    for n in (1, 4, 16):
        rows = stats.class_moments(long.repartition(n), counts).collect()
        results.append({(r.label, r.fid): (r.mean, r.var) for r in rows})
    for other in results[1:]:
        assert all(np.allclose(results[0][k], other[k]) for k in results[0])


def test_streaming(spark, sf_dir, tmp_path):
    from tessera.streaming import scoring

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = f"{tmp_path}/events"
    events.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    scored = scoring.score_stream(stream, [0.1], -0.5, [F.col("value")])
    q = scored.select("event_id", "score").writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == events.count()
    model = scoring.OnlineLinear(1, learning_rate=0.001)
    rows = stream.select(F.array(F.col("value")).alias("features"), (2 * F.col("value")).alias("label"))
    q = rows.writeStream.foreachBatch(model.update).start()
    q.processAllAvailable()
    q.stop()
    assert model.weights[0] > 0
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = scoring.windowed(timed, "ts", "event_type", "value").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


@pytest.mark.parametrize("by", ["u", "v"])
def test_negatives_of_rows_with_few_free_numbers(spark, by):
    rated = {0: set(range(100)) - {57}, 1: set(range(100)), 2: set(range(0, 100, 2)), 3: {7, 99, 250}}
    pairs = [(k, x) if by == "u" else (x, k) for k, some in rated.items() for x in sorted(some)]
    got = factorization.bpr_pairs(spark.createDataFrame(pairs, "u int, v int"), 100, 5, by, draws=1).collect()
    found = {(r.u, r.v): r.w for r in got}
    assert len(found) == len(got) and set(found) == {p for p in pairs if p[by == "v"] != 1}
    assert all(0 <= w < 100 and w not in rated[p[by == "v"]] for p, w in found.items())
    assert {w for p, w in found.items() if p[by == "v"] == 0} == {57}


def test_batches_of_a_regression_take_no_job_each(spark, monkeypatch):
    """One aggregate gives what all steps need; batches whose predictions may be cut off are read."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(1230, 3)), rng.normal(size=1230)
    rows = [(5 * i, float(b), [0, 1, 2], [float(v) for v in a]) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id bigint, label double, indices array<int>, values array<double>").repartition(5).cache()
    for scale, reads in ((1.0, 0), (400.0, 12)):  # large steps are cut off
        w, b, seen, read = np.zeros(3), 0.0, [], []
        for lo in range(0, 1230, 110):
            part, goal = x[lo : lo + 110], y[lo : lo + 110]
            seen.append(0.5 * ((part @ w + b - goal) ** 2).mean())
            g = np.clip(part @ w + b, -20, 20) - goal
            w, b = w - 0.05 * scale * part.T @ g / len(goal), b - 0.05 * scale * g.mean()
        step = linear.LinearRegression.step
        monkeypatch.setattr(linear.LinearRegression, "step", lambda self, batch: read.append(1) or step(self, batch))
        model = linear.LinearRegression(num_epoch=1, batch_size=110, learning_rate=0.05 * scale).fit(df)
        monkeypatch.setattr(linear.LinearRegression, "step", step)
        assert np.allclose(model.weights, w) and math.isclose(model.bias, b, rel_tol=1e-6)
        assert math.isclose(model.history[0][3], np.mean(seen), rel_tol=1e-6)
        assert len(read) <= reads and (scale == 1 or read)


def test_ranges_are_bounded(spark, monkeypatch):
    """Numbers follow the key, and no range has much more rows than it may."""
    monkeypatch.setattr(readers, "RANGE_ROWS", 50)
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = readers.ranked(df, "k", "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1000))
    dealt, starts = readers.ranges(df, "k", 1000)
    assert len(starts) >= 20 and max(b - a for a, b in zip(starts, starts[1:])) < 200 and starts[-1] == 1000
    assert readers.ranked(df.limit(0), "k", "n").count() == 0


def test_knn_blocks_copy_both_sides_few_times(spark):
    """Both sides are cut alike, and a block's search takes ids, not a matrix of all its pairs."""
    import re

    points = spark.range(6000).select(F.col("id").alias("row_id"), F.lit(0).alias("label"), F.array(F.col("id").cast("double")).alias("features"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        plan = neighbors.nearest(points, points, 2, skip_self=True)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(re.findall(r"sequence\((?:cast\()?0[^,]*, (?:cast\()?(\d+)", plan)) == {"3"}
    x, ids = np.arange(30_000.0)[:, None], np.arange(30_000)
    q, r, _ = neighbors.best_of_block(x[:300], x, 1, (ids[:300], ids))
    assert set(zip(q.tolist(), r.tolist())) == {(a, b) for a in range(300) for b in (a - 1, a + 1) if b >= 0}
