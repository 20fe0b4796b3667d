"""The user-facing classes, end to end on files and arrays."""

from __future__ import annotations

import numpy as np
import pytest

from tessera import api
from tessera.operators.params import parse


class Sparse:
    """Looks like a compressed sparse row matrix."""

    def __init__(self, indices, indptr, data):
        self.indices, self.indptr, self.data = indices, indptr, data


def test_file_to_scores(spark, tmp_path):
    rng = np.random.default_rng(0)
    lines = []
    for i in range(200):
        y = 1 if i % 2 else -1
        lines.append(f"{y} 1:{y + rng.normal() / 2:.4f} 3:{rng.normal():.4f}")
    (tmp_path / "a.svm").write_text("\n".join(lines) + "\n")
    data = api.Dataset.from_file(f"file://{tmp_path}/a.svm", neg_y=True)
    assert (data.get_num_instances(), data.get_max_dim()) == (200, 3)
    half = api.Dataset.from_file(f"file://{tmp_path}/a.svm", neg_y=True, rank=1, total_ranks=2)
    assert half.get_num_instances() == 100
    model = api.LogisticRegression(num_epoch=3, batch_size=100, learning_rate=0.5, parallel=True).fit(data, data)
    assert model.evaluate(data, ["precision"]).first()[0] > 0.9
    svm = api.SupportVectorMachine.from_args({"NUM_EPOCH": "1", "BATCH_SIZE": "100", "UNKNOWN": "x"}).fit(data)
    assert svm["num_epoch"] == 1 and svm.predict_score(data).count() == 200


def test_arrays(spark):
    matrix = Sparse([0, 1, 0, 1], [0, 1, 2, 3, 4], [1.0, 1.0, 2.0, 2.0])
    data = api.Dataset.from_data((matrix, [0, 1, 0, 1]))
    assert api.CSRMatrix.from_data(matrix).get_num_cols() == 2
    score = api.KNN(2, 1).predict_score(data, data)
    assert score.count() == 4 and api.KNN(2, 1).evaluate(data, data, ["precision"]).first()[0] == 1.0
    with pytest.raises(TypeError):
        api.CSRMatrix.from_data([1])
    ratings = api.COOMatrix.from_data(([0, 1], [1, 2], [3.0, 4.0]))
    assert (ratings.get_num_rows(), ratings.get_num_cols()) == (2, 3)
    assert api.NMF(embedding_dim=2, num_epoch=1).fit(ratings).predict(ratings).count() == 2
    assert api.NMF(embedding_dim=2, num_epoch=1, objective="bpr", nonnegative=False).fit(ratings).predict(ratings).count() == 2


def test_sizes_of_one_column(spark):
    one = Sparse([0, 0], [0, 1, 2], [1.0, 1.0])
    assert api.CSRMatrix.from_data(one).get_num_cols() == 1 and api.Dataset.from_data((one, [0, 1])).get_max_dim() == 1
    assert api.COOMatrix.from_data(([0], [0], [1.0])).get_num_rows() == 1
    assert api.CSRMatrix.from_data(Sparse([], [0, 0], [])).get_num_cols() == 0


def test_arrays_in_and_out(spark, tmp_path):
    x = np.array([1.5, 2.5, -1.0])
    assert (api.to_array(api.from_array(x), "value", "row_id") == x).all()
    assert api.to_array(api.from_array(np.arange(4)), "value", "row_id").dtype.kind == "i"
    with pytest.raises(TypeError):
        api.from_array(np.zeros((2, 2)))
    api.KNN(3, 2).save_model(spark, f"file://{tmp_path}/knn")
    assert api.KNN.load_model(spark, f"file://{tmp_path}/knn").params == {"num_label": 3, "num_neighbor": 2}
    cluster = api.Cluster(num_workers=3, role="server")
    cluster.init_ps(), cluster.start_server("int"), cluster.finalize_ps()
    assert (cluster.num_workers, cluster.num_servers, cluster.is_server(), cluster.is_worker(), cluster.is_scheduler()) == (3, 1, True, False, False)


def test_sparse_takes_no_dense(spark):
    from tessera.operators import sparse

    with pytest.raises(TypeError):
        sparse.axpy_sparse_dense(None, 1.0, None)


def test_corpus(spark, tmp_path):
    (tmp_path / "c.txt").write_text("0 1 2 1\n1 0 2\n")
    corpus = api.Corpus.from_file(3, f"file://{tmp_path}/c.txt")
    assert (corpus.get_num_docs(), corpus.get_num_words(), corpus.get_num_tokens()) == (2, 3, 5)
    assert (corpus.get_word_size(1), corpus.get_doc_size(0)) == (2, 3)
    assert api.LDA(num_words=3, num_topics=2, num_iters=1).fit(corpus).predict(corpus).count() == 5


def test_parameters():
    assert parse("true", False) is True and parse("1,2", [0]) == [1, 2] and parse("0.5", 1.0) == 0.5
    with pytest.raises(ValueError):
        parse("maybe", True)
    with pytest.raises(ValueError):
        api.GBDT(nonsense=1)
    assert api.GBDT(aux_args={"num_round": 3})["num_round"] == 3
    with pytest.raises(ValueError):
        api.Cluster(role="cook")
