"""Principal components from one aggregate of second moments; scoring is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError
from tessera.functions.linalg import check, col, gram_columns, gram_matrix, moments, total
from tessera.operators.models.base import Model, need_rows


@dataclass(frozen=True)
class PCAModel(Model):
    """components: features by components; each one's largest loading is positive."""

    features: tuple[str, ...]
    means: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        self._check(df)
        return df.withColumns({f"{prefix}{j}": total([(col(c) - F.lit(float(m))) * F.lit(float(v)) for c, m, v in zip(self.features, self.means, self.components[:, j], strict=True)]) for j in range(self.components.shape[1])})


@dataclass(frozen=True)
class PCA:
    n: int | None = None
    centre: bool = True

    def fit(self, df: DataFrame, features: Sequence[str]) -> PCAModel:
        d = len(features)
        if self.n is not None and not 1 <= self.n <= d:
            raise InvalidDataError(f"{self.n} components of {d} features")
        check(df, features)
        if self.centre:
            rows, means, second = moments(df, features)
            need_rows(rows, 2)
        else:
            row = df.agg(F.count("*").alias("n"), *gram_columns([col(c).cast("double") for c in features])).first()
            need_rows(row["n"])
            rows, means, second = row["n"], np.zeros(d), gram_matrix(row, d) / row["n"]
        values, vectors = np.linalg.eigh(second)
        order = np.argsort(-values, kind="stable")[: self.n or min(d, rows)]
        vectors = vectors[:, order]
        flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        return PCAModel(tuple(features), means, vectors * np.where(flip == 0, 1, flip), values[order])
