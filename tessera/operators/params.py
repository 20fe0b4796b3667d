"""Hyper-parameters with defaults and checks, and the estimator base."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import vectors as V
from ..sources import persist


class Params(dict):
    """Name to value; names that no default has are refused, aux_args add to them."""

    def updated(self, **values) -> Params:
        unknown = set(values) - set(self)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return Params({**self, **values})


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def frame_of(data):
    """The DataFrame of a data set, or the value itself."""
    return getattr(data, "frame", data)


def parse(text: str, like):
    """A parameter's text as the type of its default."""
    if isinstance(like, bool):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"not a boolean: {text}")
        return text.lower() in ("true", "1")
    if isinstance(like, (list, tuple)):
        return [parse(x, like[0] if like else "") for x in text.split(",") if x]
    return type(like)(text)


def _takes_frames(f):
    @wraps(f)
    def call(self, *data, **named):
        return f(self, *map(frame_of, data), **{k: frame_of(v) for k, v in named.items()})

    return call


class Supervised:
    """fit, predict_score, predict_proba, evaluate, save_model and load_model.

    Training data are sparse rows (row_id, label, indices, values). `history` has
    (epoch, split, metric, value) rows of the fit.
    """

    name = ""
    regression = False
    signed = False

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        for name in ("fit", "predict_score"):
            if name in cls.__dict__:
                setattr(cls, name, _takes_frames(cls.__dict__[name]))

    @classmethod
    def from_args(cls, args: dict[str, str]):
        """From texts; names that the learner doesn't know are skipped."""
        known = cls.defaults()
        return cls(**{k.lower(): parse(v, known[k.lower()]) for k, v in args.items() if k.lower() in known})

    def __init__(self, **values):
        aux = values.pop("aux_args", None) or {}
        values.pop("parallel", None)  # every fit is distributed
        self.params = Params(self.defaults()).updated(**{**values, **aux})
        self.history: list[tuple] = []
        self.check()

    @classmethod
    def defaults(cls) -> dict:
        return {}

    def check(self) -> None:
        pass

    def __getitem__(self, key):
        return self.params[key]

    def family(self) -> str:
        return "signed" if self.signed else "binary"

    def predict_score(self, data: DataFrame) -> DataFrame:
        raise NotImplementedError

    def predict_proba(self, data: DataFrame) -> DataFrame:
        scored = self.predict_score(data)
        if self.regression:
            return scored.withColumnRenamed("score", "proba")
        vector = scored.schema["score"].dataType.typeName() == "array"
        return scored.select("row_id", (V.softmax("score") if vector else V.sigmoid("score")).alias("proba"))

    def evaluate(self, data: DataFrame, metrics: list[str] | None = None) -> DataFrame:
        data = frame_of(data)
        names = metrics or [m for m in str(self.params.get("metrics", "")).split(",") if m]
        scored = self.predict_score(data).join(data.select("row_id", "label"), "row_id")
        vector = scored.schema["score"].dataType.typeName() == "array"
        return M.evaluate(scored, names, "multi" if vector else self.family())

    def _log(self, epoch: int, valid: DataFrame | None) -> None:
        if valid is not None and self.params.get("metrics"):
            row = self.evaluate(valid).first().asDict()
            self.history += [(epoch, "valid", k, v) for k, v in row.items()]

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        raise NotImplementedError

    def restore(self, parts: dict[str, DataFrame]) -> None:
        raise NotImplementedError

    def save_model(self, spark: SparkSession, path: str) -> None:
        persist.save(spark, path, self.name, dict(self.params), self.parts(spark))

    @classmethod
    def load_model(cls, spark: SparkSession, path: str):
        params, parts = persist.load(spark, path, cls.name)
        model = cls(**params)
        model.restore(parts)
        return model


def rows_of(df: DataFrame) -> DataFrame:
    """Only what a learner reads."""
    return df.select("row_id", F.col("label").cast("double").alias("label"), "indices", "values")
