"""One place for users of the learners: data classes with factories, and every estimator.

Data sets hold a DataFrame (`frame`); estimators take either. `parallel`, `rank` and `total_ranks`
keep the calls of a multi-process program valid: a rank reads its share of the lines, and every fit
is distributed anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bayes import NaiveBayes
from .operators.factorization import NMF
from .operators.linear import FactorizationMachine, LinearRegression, LogisticRegression, SupportVectorMachine
from .operators.neighbors import KNN
from .operators.topics import LDA
from .operators.trees import GBDT, RandomBoostedForest
from .sources import readers

FM = FactorizationMachine

__all__ = ["COOMatrix", "CSRMatrix", "Cluster", "Corpus", "Dataset", "FM", "FactorizationMachine", "GBDT", "KNN", "LDA", "LinearRegression", "LogisticRegression", "NMF", "NaiveBayes", "RandomBoostedForest", "SupportVectorMachine"]


def session() -> SparkSession:
    return SparkSession.builder.getOrCreate()


def _csr(matrix) -> tuple:
    """indices, indptr and values of a compressed sparse row matrix, or of what converts to one."""
    if hasattr(matrix, "tocsr"):
        matrix = matrix.tocsr()
    if not all(hasattr(matrix, x) for x in ("indices", "indptr", "data")):
        raise TypeError("a sparse matrix is needed")
    return matrix.indices, matrix.indptr, matrix.data


def _past(frame: DataFrame, index: Column) -> int:
    """One more than the largest index; 0 where there is none."""
    last = frame.agg(F.max(index)).first()[0]
    return 0 if last is None else last + 1


def to_array(frame: DataFrame, column: str, order: str | None = None):
    """A column as a one-dimensional numpy array, in the order of another column: for results that fit
    the driver."""
    rows = frame.orderBy(order).select(column) if order else frame.select(column)
    return rows.toArrow().column(0).to_numpy()


def from_array(values, name: str = "value") -> DataFrame:
    """A one-dimensional array as (row_id, value)."""
    if getattr(values, "ndim", 1) != 1:
        raise TypeError("one dimension is needed")
    kind = {"i": "bigint", "u": "bigint", "b": "boolean"}.get(getattr(getattr(values, "dtype", None), "kind", "f"), "double")
    rows = enumerate(values.tolist() if hasattr(values, "tolist") else values)
    return session().createDataFrame(list(rows), f"row_id bigint, {name} {kind}")


class _Data:
    def __init__(self, frame: DataFrame):
        self.frame = frame


class CSRMatrix(_Data):
    @classmethod
    def from_data(cls, matrix) -> CSRMatrix:
        return cls(readers.from_csr(session(), *_csr(matrix)))

    def get_num_rows(self) -> int:
        return self.frame.count()

    def get_num_cols(self) -> int:
        return _past(self.frame, F.array_max("indices"))


class Dataset(_Data):
    @classmethod
    def from_file(cls, path: str, data_format: str = "libsvm", neg_y: bool = False, rank: int = 0, total_ranks: int = 1) -> Dataset:
        frame = readers.read_dataset(session(), path, data_format, neg_y=neg_y, rank=rank, total=total_ranks)
        return cls(readers.from_dense(frame) if "features" in frame.columns else frame)

    @classmethod
    def from_data(cls, data) -> Dataset:
        matrix, labels = data
        return cls(readers.from_csr(session(), *_csr(matrix), labels))

    def get_num_instances(self) -> int:
        return self.frame.count()

    def get_max_dim(self) -> int:
        return _past(self.frame, F.array_max("indices"))


class COOMatrix(_Data):
    @classmethod
    def from_file(cls, path: str) -> COOMatrix:
        return cls(readers.read_coo(session(), path))

    @classmethod
    def from_data(cls, data) -> COOMatrix:
        if hasattr(data, "tocoo"):
            data = data.tocoo()
            data = data.row, data.col, data.data
        return cls(readers.from_coo(session(), *data))

    def get_num_rows(self) -> int:
        return _past(self.frame, F.col("u"))

    def get_num_cols(self) -> int:
        return _past(self.frame, F.col("v"))


class Corpus(_Data):
    def __init__(self, frame: DataFrame, num_words: int):
        super().__init__(frame)
        self.num_words = num_words

    @classmethod
    def from_file(cls, num_words: int, path: str, rank: int = 0, total_ranks: int = 1) -> Corpus:
        return cls(readers.read_corpus(session(), path, rank=rank, total=total_ranks), num_words)

    def get_num_docs(self) -> int:
        return self.frame.agg(F.countDistinct("doc_id")).first()[0]

    def get_num_words(self) -> int:
        return self.num_words

    def get_num_tokens(self) -> int:
        return self.frame.count()

    def get_word_size(self, word_id: int) -> int:
        return self.frame.where(F.col("word_id") == word_id).count()

    def get_doc_size(self, doc_id: int) -> int:
        return self.frame.where(F.col("doc_id") == doc_id).count()


class Cluster:
    """The roles of a multi-process program; Spark's driver and executors take them all."""

    def __init__(self, scheduler: str = "", num_servers: int = 1, num_workers: int = 1, role: str = "worker"):
        if role not in ("scheduler", "server", "worker"):
            raise ValueError(f"no such role: {role}")
        self.num_servers, self.num_workers, self.role = num_servers, num_workers, role

    def start_server(self, dtype: str = "double") -> None:
        if dtype not in ("int", "float", "double"):
            raise ValueError(f"no such type: {dtype}")

    def my_rank(self) -> int:
        return 0

    def init_ps(self) -> None:
        """The session is the cluster."""
        session()

    def is_scheduler(self) -> bool:
        return self.role == "scheduler"

    def is_server(self) -> bool:
        return self.role == "server"

    def is_worker(self) -> bool:
        return self.role == "worker"

    def finalize_ps(self) -> None:
        """Nothing runs that would have to end: state is written tables."""

    def barrier(self) -> None:
        """An action is a barrier."""

    def join(self) -> None:
        """Nothing waits: tasks end with their stage."""
