"""Sums and small matrices: distributed aggregates for the statistics, numpy on the driver for the solves.

Only matrices of features by features (or training rows by training rows, where a model needs them) reach the driver."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, LinearAlgebraError


def col(name: str | Column) -> Column:
    return name if isinstance(name, Column) else F.col(f"`{name}`") if "." in name else F.col(name)


def total(terms: Sequence[Column]) -> Column:
    """The sum of the columns, added from the left."""
    return reduce(lambda a, b: a + b, terms, F.lit(0.0)) if not terms else reduce(lambda a, b: a + b, terms)


def linear(weights: Sequence[float], features: Sequence[str], intercept: float = 0.0) -> Column:
    """intercept + weights . features, in one projection."""
    return total([F.lit(float(intercept)), *(col(c) * F.lit(float(w)) for w, c in zip(weights, features, strict=True))])


def bad(name: str | Column) -> Column:
    """Whether the value is null, NaN or infinite."""
    x = col(name)
    return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))


def check(df: DataFrame, columns: Sequence[str]) -> None:
    """Raises if any of the columns holds a null or non-finite value; one aggregate."""
    row = df.agg(*(F.count_if(bad(c)).alias(f"c{i}") for i, c in enumerate(columns))).first()
    wrong = [c for i, c in enumerate(columns) if row[i]]
    if wrong:
        raise InvalidDataError(f"null or non-finite values in {', '.join(wrong)}")


def gram_columns(terms: Sequence[Column], weight: Column | None = None) -> list[Column]:
    """Sums of products of each pair of terms (upper triangle, row by row), weighted if a weight is given."""
    return [F.sum(a * b if weight is None else weight * a * b).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]


def gram_matrix(row, size: int) -> np.ndarray:
    """The symmetric matrix of gram_columns' results."""
    out = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            value = row[f"g{i}_{j}"]
            out[i, j] = out[j, i] = np.nan if value is None else value
    return out


def moments(df: DataFrame, features: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, sample covariance) in one aggregate, updated stably by row."""
    aggs = [F.count("*").alias("n"), *(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features))]
    aggs += [F.covar_samp(col(a), col(b)).alias(f"g{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    row = df.agg(*aggs).first()
    if not row["n"]:
        raise InvalidDataError("no rows")
    return row["n"], np.array([row[f"m{i}"] for i in range(len(features))], dtype=float), gram_matrix(row, len(features))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of a x = b; an error if a is singular or not finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        raise LinearAlgebraError("non-finite values in the system")
    try:
        out = np.linalg.solve(a, b)
    except np.linalg.LinAlgError as e:
        raise LinearAlgebraError(str(e)) from e
    if not np.isfinite(out).all() or np.linalg.cond(a) > 1e15:
        raise LinearAlgebraError("singular matrix")
    return out


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower factor; an error if a isn't positive definite."""
    try:
        return np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise LinearAlgebraError(str(e)) from e


def inverse_and_det(a: np.ndarray) -> tuple[np.ndarray, float]:
    """The inverse by a pivoted factorisation, and the determinant."""
    det = float(np.linalg.det(a))
    return solve(a, np.eye(len(a))), det
