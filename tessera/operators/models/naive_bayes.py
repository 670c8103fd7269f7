"""Naive Bayes: one grouped aggregate to fit, one projection to score. Priors are class shares, unsmoothed."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidDataError, InvalidParametersError
from tessera.functions import scalar
from tessera.functions.linalg import bad, col
from tessera.operators.models.base import Model, need_rows


@dataclass(frozen=True)
class NaiveBayesModel(Model):
    kind: object
    features: tuple[str, ...]
    label: str
    classes: tuple
    counts: np.ndarray
    parameters: dict[str, np.ndarray] | list

    @property
    def priors(self) -> np.ndarray:
        return self.counts / self.counts.sum()

    def log_joint(self) -> list[Column]:
        """The log joint likelihood of a row with each class."""
        out = []
        for k, prior in enumerate(self.priors):
            if not isinstance(self.kind, str):
                score = self.kind.log_likelihood(self.features, self.parameters[k])
            elif self.kind == "gaussian":
                mean, var = self.parameters["mean"][k], self.parameters["variance"][k]
                parts = [scalar.gaussian_log_density(c, m, v) for c, m, v in zip(self.features, mean, var, strict=True)]
                score = parts[0]
                for p in parts[1:]:
                    score = score + p
            elif self.kind == "bernoulli":
                score = scalar.bernoulli_log_likelihood(self.features, self.parameters["log_p"][k])
            else:
                score = scalar.multinomial_log_likelihood(self.features, self.parameters["log_p"][k])
            out.append(score + F.lit(math.log(prior)))
        return out

    def transform(self, df: DataFrame, scores: str | None = None) -> DataFrame:
        """Adds prediction: the class of the largest log joint likelihood, the first of equals."""
        self._check(df)
        joint = self.log_joint()
        best = F.array_min(F.array(*(F.struct((-s).alias("s"), F.lit(i).alias("i")) for i, s in enumerate(joint))))["i"]
        # The classes' list in a map-free form: nested conditions keep the label's type.
        out = df.withColumn("_best", best)
        label = F.coalesce(*(F.when(F.col("_best") == i, F.lit(c)) for i, c in enumerate(self.classes)))
        out = out.withColumn("prediction", label).drop("_best")
        return out.withColumn(scores, F.array(*joint)) if scores else out


@dataclass(frozen=True)
class NaiveBayes:
    """kind: "gaussian" (sample variances), "bernoulli" (rates with one success and one failure added) or "multinomial"
    (shares with one added to each feature's sum); or a distribution of your own, with aggregates(features) -> aliased
    aggregate Columns, parameters(row of them with the count n) -> anything, and log_likelihood(features, parameters) ->
    Column."""

    kind: object = "gaussian"

    def __post_init__(self):
        if isinstance(self.kind, str) and self.kind not in ("gaussian", "bernoulli", "multinomial"):
            raise InvalidParametersError(f"unknown kind {self.kind}")

    def _aggregates(self, features: Sequence[str], shift: Sequence[float]) -> list[Column]:
        out = [F.count("*").alias("n"), *(F.sum(col(c).cast("double") - s).alias(f"s{i}") for i, (c, s) in enumerate(zip(features, shift, strict=True)))]
        if self.kind == "gaussian":
            out += [F.sum((col(c).cast("double") - s) * (col(c).cast("double") - s)).alias(f"q{i}") for i, (c, s) in enumerate(zip(features, shift, strict=True))]
        return out + [F.count_if(bad(c)).alias(f"b{i}") for i, c in enumerate(features)]

    def _shift(self, df: DataFrame, features: Sequence[str]) -> list[float]:
        """Means, so that squares keep their digits; sums of counts need none."""
        if self.kind != "gaussian":
            return [0.0] * len(features)
        row = df.agg(*(F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(features))).first()
        return [row[f"m{i}"] or 0.0 for i in range(len(features))]

    def _model(self, features: Sequence[str], label: str, sums: dict, shift: Sequence[float]) -> NaiveBayesModel:
        classes = sorted(c for c, v in sums.items() if v[0] > 0)
        need_rows(len(classes))
        d = len(features)
        n = np.array([sums[c][0] for c in classes], dtype=float)
        s = np.array([sums[c][1 : 1 + d] for c in classes], dtype=float)
        if self.kind == "gaussian":
            if (n < 2).any():
                raise InvalidDataError("a class has a single row")
            q = np.array([sums[c][1 + d : 1 + 2 * d] for c in classes], dtype=float)
            mean = s / n[:, None]
            variance = (q - n[:, None] * mean**2) / (n[:, None] - 1)
            if (variance <= 0).any():
                raise InvalidDataError("a feature is constant within a class")
            parameters = {"mean": mean + np.array(shift), "variance": variance}
        elif self.kind == "bernoulli":
            parameters = {"log_p": np.log((s + 1) / (n[:, None] + 2))}
        else:
            parameters = {"log_p": np.log((s + 1) / (s + 1).sum(axis=1, keepdims=True))}
        return NaiveBayesModel(self.kind, tuple(features), label, tuple(classes), n, parameters)

    def _rows(self, rows, features: Sequence[str], label: str) -> dict:
        d = len(features)
        out = {}
        for r in rows:
            if r[label] is None or any(r[f"b{i}"] for i in range(d)):
                raise InvalidDataError("null or non-finite values")
            out[r[label]] = np.array([r["n"], *(r[f"s{i}"] for i in range(d)), *((r[f"q{i}"] for i in range(d)) if self.kind == "gaussian" else ())], dtype=float)
        return out

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> NaiveBayesModel:
        if not isinstance(self.kind, str):
            rows = sorted(df.groupBy(col(label).alias("_class")).agg(F.count("*").alias("n"), *self.kind.aggregates(features)).collect(), key=lambda r: r["_class"])
            need_rows(len(rows))
            return NaiveBayesModel(self.kind, tuple(features), label, tuple(r["_class"] for r in rows), np.array([r["n"] for r in rows], dtype=float), [self.kind.parameters(r) for r in rows])
        shift = self._shift(df, features)
        return self._model(features, label, self._rows(df.groupBy(col(label).alias(label)).agg(*self._aggregates(features, shift)).collect(), features, label), shift)

    def fit_folds(self, df: DataFrame, features: Sequence[str], label: str, fold: str, k: int) -> list[NaiveBayesModel]:
        """Models of all complements of folds from one pass: sums of all less those of the fold."""
        if not isinstance(self.kind, str):
            return [self.fit(df.where(F.col(fold) != i), features, label) for i in range(k)]
        shift = self._shift(df, features)
        rows = df.groupBy(fold, label).agg(*self._aggregates(features, shift)).collect()
        folds = {i: self._rows([r for r in rows if r[fold] == i], features, label) for i in range(k)}
        whole: dict = {}
        for sums in folds.values():
            for c, v in sums.items():
                whole[c] = whole.get(c, 0) + v
        return [self._model(features, label, {c: v - folds[i].get(c, 0) for c, v in whole.items()}, shift) for i in range(k)]
