"""What all estimators share."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessera.errors import InvalidDataError, InvalidStateError, UntrainedModelError


class Model:
    """A fitted model. `transform` adds `prediction`; where scoring is a projection, streaming frames work too."""

    features: tuple[str, ...]

    def _check(self, df: DataFrame) -> None:
        missing = [c for c in self.features if c not in df.columns]
        if missing:
            raise InvalidStateError(f"missing columns {missing}")

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def parameters_json(self) -> str:
        """The fitted values that are numbers, names or arrays of them; frames and functions are left out."""
        out = {}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, dict):
                v = {k: np.asarray(x).tolist() for k, x in v.items()}
            elif isinstance(v, np.ndarray):
                v = v.tolist()
            elif not isinstance(v, (int, float, str, tuple, list)) or isinstance(v, tuple) and not all(isinstance(x, (int, float, str)) for x in v):
                continue
            out[f.name] = v
        return json.dumps(out, default=str)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row: the model's kind and its values as JSON, ready to be written anywhere."""
        return spark.createDataFrame([(type(self).__name__, self.parameters_json())], "kind string, parameters string")


class Trainable:
    """A facade that keeps the last fitted model: `train`, then `predict`."""

    def __init__(self, estimator):
        self.estimator, self._model = estimator, None

    def train(self, df: DataFrame, features: Sequence[str], *args, **kwargs) -> Trainable:
        self._model = self.estimator.fit(df, features, *args, **kwargs)
        return self

    @property
    def model(self) -> Model:
        if self._model is None:
            raise UntrainedModelError
        return self._model

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def need_rows(n: int, least: int = 1) -> None:
    if n < least:
        raise InvalidDataError(f"at least {least} rows are needed, there are {n}")
