"""Linear, logistic and generalised linear regression.

Every statistic is one aggregate of a fixed number of sums; the driver solves systems of features by features.
Parameters begin with the intercept."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, LinearAlgebraError
from tessera.functions import scalar
from tessera.functions.linalg import bad, col, gram_columns, gram_matrix, linear, solve
from tessera.operators.models.base import Model, need_rows
from tessera.operators.optim import GradientDescent


@dataclass(frozen=True)
class LinearModel(Model):
    features: tuple[str, ...]
    parameters: np.ndarray
    link: scalar.Link = scalar.IDENTITY

    def expr(self) -> Column:
        return self.link.inverse(linear(self.parameters[1:], self.features, self.parameters[0]))

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        return df.withColumn("prediction", self.expr())


def _sums(df: DataFrame, features: Sequence[str], label: str) -> tuple[int, np.ndarray]:
    """(rows, Gram matrix of [1, centred features, centred label], means) — centring keeps the digits of large values."""
    names = [*features, label]
    first = df.agg(F.count("*").alias("n"), *(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(names)), *(F.count_if(bad(c)).alias(f"b{i}") for i, c in enumerate(names))).first()
    need_rows(first["n"])
    wrong = [c for i, c in enumerate(names) if first[f"b{i}"]]
    if wrong:
        raise InvalidDataError(f"null or non-finite values in {wrong}")
    means = np.array([first[f"m{i}"] for i in range(len(names))], dtype=float)
    row = df.agg(*gram_columns([col(c) - F.lit(float(m)) for c, m in zip(names, means, strict=True)])).first()
    return first["n"], means, gram_matrix(row, len(names))


@dataclass(frozen=True)
class LinearRegression:
    """Least squares: two aggregates and one solve."""

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
        n, means, gram = _sums(df, features, label)
        return LinearModel(tuple(features), self._solve(n, means, gram))

    @staticmethod
    def _solve(n: int, means: np.ndarray, gram: np.ndarray) -> np.ndarray:
        d = len(means) - 1
        scale = np.sqrt(np.diag(gram)[:d])
        if (scale == 0).any():
            raise LinearAlgebraError("a feature is constant")
        beta = solve(gram[:d, :d] / np.outer(scale, scale), gram[:d, d] / scale) / scale
        return np.concatenate([[means[d] - beta @ means[:d]], beta])

    def fit_folds(self, df: DataFrame, features: Sequence[str], label: str, fold: str, k: int) -> list[LinearModel]:
        """Models of all complements of folds from one grouped aggregate: sums of all less those of the fold."""
        names = [*features, label]
        _, means, _ = _sums(df, features, label)
        terms = [F.lit(1.0), *(col(c) - F.lit(float(m)) for c, m in zip(names, means, strict=True))]
        rows = {r[fold]: gram_matrix(r, len(terms)) for r in df.groupBy(fold).agg(*gram_columns(terms)).collect()}
        whole, out = sum(rows.values()), []
        for i in range(k):
            g = whole - rows[i]
            n, shift = g[0, 0], g[0, 1:] / g[0, 0]
            out.append(LinearModel(tuple(features), self._solve(int(n), means + shift, g[1:, 1:] - n * np.outer(shift, shift))))
        return out


@dataclass(frozen=True)
class LinearRegressionGD:
    """Least squares by an optimiser from zero. The Gram matrix suffices for every cost and gradient, so iterations make
    no further pass."""

    algorithm: object = field(default_factory=GradientDescent)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
        terms = [F.lit(1.0), *(col(c).cast("double") for c in features), col(label).cast("double")]
        g = gram_matrix(df.agg(*gram_columns(terms)).first(), len(terms))
        n, d = g[0, 0], len(features) + 1
        if not n >= 1:
            raise InvalidDataError("no rows, or null values")

        def oracle(w: np.ndarray) -> tuple[float, np.ndarray]:
            error = g[:d, :d] @ w - g[:d, d]
            return float(w @ g[:d, :d] @ w - 2 * w @ g[:d, d] + g[d, d]) / (2 * n), error / n

        return LinearModel(tuple(features), self.algorithm.minimise(oracle, np.zeros(d)))


@dataclass(frozen=True)
class LogisticRegression:
    """Logistic regression by an optimiser from 0.5 each; one aggregate for each cost and gradient. Predictions are
    probabilities."""

    algorithm: object = field(default_factory=GradientDescent)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
        data = df.select(*(col(c).cast("double").alias(c) for c in [*features, label])).cache()
        try:
            need_rows(data.limit(1).count())
            y = col(label)
            terms = [F.lit(1.0), *(col(c) for c in features)]

            def oracle(w: np.ndarray) -> tuple[float, np.ndarray]:
                h = scalar.SIGMOID.func(linear(w[1:], features, w[0]))
                safe = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), h))
                row = data.agg((-F.avg(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("c"), *(F.avg((h - y) * t).alias(f"g{i}") for i, t in enumerate(terms))).first()
                if row["c"] is None:
                    raise InvalidDataError("null values")
                return row["c"], np.array([row[f"g{i}"] for i in range(len(terms))])

            return LinearModel(tuple(features), self.algorithm.minimise(oracle, np.full(len(terms), 0.5)), scalar.LOGIT)
        finally:
            data.unpersist()


@dataclass(frozen=True)
class Family:
    """A distribution of a generalised linear model: its link, variance by mean, first mean by target (lagged
    schedule), iteration weight, first mean (textbook)."""

    name: str
    link: scalar.Link
    variance: object
    first: object
    weight: object
    start: object
    bound: object = lambda m: m  # keeps means where the link is finite


def _clamped(y: Column) -> Column:
    return F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), y))


_binary_variance = lambda m: F.greatest(m * (1 - m), F.lit(1e-10))
BERNOULLI = Family("bernoulli", scalar.LOGIT, _binary_variance, _clamped, lambda m: F.greatest(_binary_variance(m), F.lit(1e-5)), lambda y: (y + 0.5) / 2, _clamped)
POISSON = Family("poisson", scalar.LOG, lambda m: m, lambda y: F.greatest(y, F.lit(1e-10)), lambda m: m, lambda y: y + 0.1)
NORMAL = Family("normal", scalar.IDENTITY, lambda m: F.lit(1.0), lambda y: y, lambda m: F.lit(1.0), lambda y: y)


def binomial(weights: str) -> Family:
    """Rates of rows whose iteration weight is their variance by the column weights (one over the number of tries)."""
    return Family("binomial", scalar.LOGIT, _binary_variance, _clamped, lambda m: F.greatest(_binary_variance(m) / col(weights), F.lit(1e-5)), lambda y: (y + 0.5) / 2, _clamped)


@dataclass(frozen=True)
class GeneralizedLinearRegression:
    """Iteratively reweighted least squares, one aggregate a round.

    lagged: the working response is made from the means of the round before and the current predictor, and starts as the
    first means themselves (8 rounds); otherwise the textbook method, which ends at the maximum likelihood."""

    family: Family
    iterations: int | None = None
    lagged: bool = False
    tolerance: float = 1e-10

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
        fam, link = self.family, self.family.link
        data = df.cache()
        try:
            need_rows(data.limit(1).count())
            y, terms = col(label).cast("double"), [F.lit(1.0), *(col(c).cast("double") for c in features)]
            beta, before, mean, z = None, None, fam.first(y) if self.lagged else fam.start(y), None

            def step(m: Column) -> Column:
                change = y - m
                return F.when(F.abs(change) < 1e-15, 0.0).otherwise(link.grad(m) * change)

            for _ in range(self.iterations or (8 if self.lagged else 25)):
                if beta is None:
                    w, z = fam.weight(mean), mean if self.lagged else link.func(mean) + step(mean)
                else:
                    eta = linear(beta[1:], features, beta[0])
                    # The lagged schedule takes the correction from the means that gave this beta.
                    last = mean
                    mean = fam.bound(link.inverse(eta))
                    w, z = fam.weight(mean), eta + step(last if self.lagged else mean)
                row = data.agg(*gram_columns([*terms, z], w)).first()
                g, d = gram_matrix(row, len(terms) + 1), len(terms)
                before, beta = beta, solve(g[:d, :d], g[:d, d])
                if before is not None and np.abs(beta - before).sum() < self.tolerance:
                    break
            return LinearModel(tuple(features), beta, link)
        finally:
            data.unpersist()
